"""Chunks of a document: its sections' pages, the paragraphs on them, packed up to a number of tokens.

Pages lie in sections by a range, so a page can be of several; a page's text is cut to what lies between the section's own
heading and the first of the other headings that begin on that page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

TOKEN_MAX = 500


def effective_ends(sections: DataFrame) -> DataFrame:
    """sections(document_id, section_id, parent_id, heading, start_page, end_page) with effective_end: where a section of the same parent, or of the top, begins inside its range, it ends there."""
    s = sections.withColumns({"start": F.coalesce("start_page", F.lit(1)), "end": F.coalesce("end_page", F.col("start_page"), F.lit(1))})
    other = sections.where("start_page is not null").select("document_id", F.col("section_id").alias("o"), F.col("parent_id").alias("op"), F.col("start_page").alias("os"))
    peer = F.col("op").isNull() | F.col("op").eqNullSafe(F.col("parent_id"))
    inside = s.join(other, "document_id").where((F.col("o") != F.col("section_id")) & (F.col("os") > F.col("start")) & (F.col("os") <= F.col("end")) & peer)
    first = inside.groupBy("document_id", "section_id").agg(F.min("os").alias("first"))
    return s.join(first, ["document_id", "section_id"], "left").withColumn("effective_end", F.least("end", F.coalesce("first", "end"))).drop("first", "end_page", "start_page")


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, section_id, heading, start, page_number, raw_text: a section's pages, by a range within the document."""
    return effective_ends(sections).join(pages, "document_id").where("page_number BETWEEN start AND effective_end")


def cut_at(text: Column, headings: Column) -> Column:
    """The text before the first of the headings that it has."""
    return F.aggregate(headings, text, lambda t, h: F.when(t.contains(h), t.substr(F.lit(1), F.instr(t, h) - 1)).otherwise(t))


def paragraphs(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, section_id, heading, start, page_number, at, paragraph: what stands in a section, page by page."""
    begins = sections.where("heading <> ''").groupBy("document_id", F.col("start_page").alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("section_id", "heading"))).alias("heads"))
    p = section_pages(sections, pages).join(begins, ["document_id", "page_number"], "left")
    h = F.trim(F.coalesce("heading", F.lit("")))
    own = F.when((h != "") & F.col("raw_text").contains(h), F.expr("substr(raw_text, instr(raw_text, trim(heading)) + length(trim(heading)))")).otherwise(F.col("raw_text"))
    others = F.transform(F.filter(F.coalesce("heads", F.expr("array()").cast("array<struct<section_id:bigint,heading:string>>")), lambda x: x["section_id"] != F.col("section_id")), lambda x: x["heading"])
    body = p.withColumn("body", own).withColumn("body", cut_at(F.col("body"), others))
    return body.select("document_id", "section_id", "heading", "start", "page_number", F.posexplode_outer(T.paragraphs(F.col("body"))).alias("at", "paragraph")).where("paragraph is not null")


def pieces(paragraph: Column, most: int = TOKEN_MAX) -> Column:
    """A paragraph as it is, or, if it has more than `most` tokens, its sentences packed up to that; a longer sentence stays whole."""
    parts = F.transform(T.sentences(paragraph), lambda s: F.struct(s.alias("text"), T.count_tokens(s).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"))
    full = lambda a, s: (F.size(a["held"]) > 0) & (a["size"] + s["n"] > most)
    step = lambda a, s: F.when(full(a, s), F.struct(F.array_append(a["out"], F.array_join(a["held"], " ")).alias("out"), F.array(s["text"]).alias("held"), s["n"].alias("size"))).otherwise(F.struct(a["out"].alias("out"), F.array_append(a["held"], s["text"]).alias("held"), (a["size"] + s["n"]).alias("size")))
    packed = F.aggregate(parts, start, step, lambda a: F.when(F.size(a["held"]) > 0, F.array_append(a["out"], F.array_join(a["held"], " "))).otherwise(a["out"]))
    return F.when(T.count_tokens(paragraph) <= most, F.array(F.trim(paragraph))).when(F.size(parts) == 0, F.array(F.trim(paragraph))).otherwise(packed)


def chunks(parts: DataFrame, most: int = TOKEN_MAX) -> DataFrame:
    """document_id, section_id, chunk, page_number, chunk_text, token_count: a section's pieces packed in order; a chunk's page is its first piece's.

    Whether a piece starts a chunk depends on all before it in its section: they stream in order, and only the chunk that grows is held.
    """
    names = ["document_id", "section_id", "chunk", "page_number", "chunk_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, page, held, size = None, 0, 0, [], 0
        for batch in batches:
            out: list[tuple] = []
            for d, s, p, text, n in zip(*(batch.column(c).to_pylist() for c in ("document_id", "section_id", "page_number", "piece", "n")), strict=True):
                if held and (key != (d, s) or size + n > most):
                    out.append((*key, number, page, " ".join(held)))
                    number, held, size = number + 1, [], 0
                if key != (d, s):
                    key, number = (d, s), 0
                page = page if held else p
                held.append(text)
                size += n
            yield table(out)
        if held:
            yield table([(*key, number, page, " ".join(held))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names)

    rows = parts.select(F.col("document_id").cast("long").alias("document_id"), F.col("section_id").cast("long").alias("section_id"), F.col("page_number").cast("int").alias("page_number"), "at", F.posexplode_outer(pieces(F.col("paragraph"), most)).alias("k", "piece")).where("piece is not null").withColumn("n", T.count_tokens(F.col("piece")))
    ordered = rows.repartition("document_id", "section_id").sortWithinPartitions("document_id", "section_id", "page_number", "at", "k")
    out = ordered.mapInArrow(run, "document_id long, section_id long, chunk int, page_number int, chunk_text string")
    return out.select("document_id", "section_id", "chunk", "page_number", F.trim("chunk_text").alias("chunk_text"), T.count_tokens(F.col("chunk_text")).alias("token_count"))
