"""The corpus pipeline: five stages over `documents`, each a whole-corpus operator of quern.llm.

A stage takes (spark, docs, sf_dir), works on every row that the stage before kept,
and returns a DataFrame, which is written as Parquet and read again.

Defined results: a null text is never toxic, near, contaminated or secret, and stays null; every
row is judged, and changed, by its own text, with or without a doc_id, so rows with one doc_id, or
none, can fare differently; equal rows are near copies of each other, of which one stays; a table
without rows gives none; further columns of documents are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, jaccard, secrets, toxicity
from quern.llm.common import written
from quern.llm.queries import vocabulary

REDACTED = "[secret]"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _row, a hash of 64 bits of doc_id and text: rows that share it are equal in both, so what is decided on the text of one holds for all."""
    return docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = toxicity.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "_toxicity")
    return judged.where("_toxicity < 0.5").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays, one without a doc_id only where no row has one. Rows without words have no copies and stay."""
    wordy = F.coalesce(F.col("text").cast("string").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    rows = keyed(docs.where(wordy))
    groups = jaccard.linked(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    stay = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    # rows that share _row and a second hash are copies of each other
    kept = rows.join(stay, "_row", "left_semi").withColumn("_again", F.xxhash64(F.lit(1), "text", F.col("doc_id").cast("long"))).dropDuplicates(["_row", "_again"])
    return kept.select(docs.columns).unionByName(docs.where(~wordy))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = keyed(docs)
    judged = decontaminate.contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(judged.where("n_hit > 0").select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan keeps is replaced; n_chars is counted anew in the changed texts. All documents stay; only those that may hold a span are scanned and joined."""
    suspect = F.coalesce(F.col("text").cast("string").rlike(secrets.SUSPECT), F.lit(False))
    rows = keyed(written(docs.where(suspect), "suspects"))
    numbered = rows.select(F.col("_row").alias("doc_id"), "text", *(c for c in ("source",) if c in docs.columns))
    spans = secrets.scan(numbered).where("size(spans) > 0").groupBy(F.col("doc_id").alias("_row")).agg(F.max("spans").alias("_spans"))
    held = rows.join(spans, "_row", "left")
    # the pieces between spans; overlapping spans are cut where the one before ended
    ends = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")), lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["text"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")), F.lit(REDACTED)).alias("text"))), lambda acc: F.concat(acc["text"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    text = F.when(F.col("_spans").isNotNull(), ends).otherwise(F.col("text"))
    out = held.withColumn("_new", text)
    columns = [F.col("_new").alias("text") if c == "text" else F.when(F.col("_spans").isNotNull(), F.length("_new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(columns).unionByName(docs.where(~suspect))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the checksums of the ids and of what they decode to."""
    return bpe.digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: No SQL: a learned classifier and a tokenizer can't be written in it. tests/llm/test_pipeline.py has brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
