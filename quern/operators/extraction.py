"""Fields by rule, and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def fields(docs: DataFrame) -> DataFrame:
    """doc_id, title, first_date, notice_days, n_amounts of docs(doc_id, text)."""
    t = F.col("text")
    title = F.coalesce(F.get(F.filter(T.lines(t), lambda x: x != ""), 0), F.lit(""))
    return docs.select("doc_id", F.regexp_extract(t, r"\b(\d{4}-\d{2}-\d{2})\b", 1).alias("first_date"), F.regexp_extract(t, r"(?i)(\d+)\s+days\s+(?:written\s+)?notice", 1).alias("notice_days"), F.size(T.extract_all(t, r"([A-Za-z][A-Za-z ]{0,40}):\s*\$\s?\d[\d,]*", 0)).alias("n_amounts"), title.alias("title"))


def first_of(rows: DataFrame, key: list[str | Column], order: list[str]) -> DataFrame:
    """Of the rows of each key the first in order: a partial minimum, so that a frequent key is reduced before the shuffle."""
    names = [k if isinstance(k, str) else f"_key{i}" for i, k in enumerate(key)]
    keyed = rows.withColumns({n: k for n, k in zip(names, key, strict=True) if not isinstance(k, str)})
    rest = [c for c in rows.columns if c not in order]
    best = keyed.groupBy(*(F.col(n).alias(f"_g{i}") for i, n in enumerate(names))).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return best.select("_row.*").select(rows.columns)
