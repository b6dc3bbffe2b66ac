"""Pages, headings, sections and chunks from lines and sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import rules as R
from quern.functions import text as T

# Fixed value: characters of a slide's title.
LONGEST_TITLE = 100


def headings(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.where(T.is_heading(line)).select("document_id", "pos", "page_number", line.alias("heading"), T.heading_level(line).alias("level"))


def pages(lines: DataFrame) -> DataFrame:
    """document_id, page_number, raw_text: the lines of each page in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("document_id", "page_number").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("raw_text"))


def sections(lines: DataFrame) -> DataFrame:
    """The section tree: the parent is the nearest heading before of a lower level; a section ends where the next of its level or lower begins.

    A document's headings stream in order past a stack of those still open, so levels have no limit.
    """
    heads = headings(lines).select("document_id", "pos", F.col("page_number").alias("start_page"), "level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, open_ = None, []  # of (row, level), levels rising
        for batch in batches:
            out: list[tuple] = []
            for d, pos, page, level in zip(*(batch.column(c).to_pylist() for c in ("document_id", "pos", "start_page", "level")), strict=True):
                while open_ and (d != doc or open_[-1][1] >= level):
                    out.append((*open_.pop()[0], pos if d == doc else None))
                doc = d
                open_.append(((d, pos, page, level, open_[-1][0][1] if open_ else None), level))
            yield table(out)
        yield table([(*row, None) for row, _ in open_])

    names = ["document_id", "pos", "start_page", "level", "parent_pos", "following"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k else pa.int64()) for k, c in enumerate(columns)], names)

    ordered = heads.select(F.col("document_id").cast("long").alias("document_id"), *(F.col(c).cast("int").alias(c) for c in names[1:4])).repartition("document_id").sortWithinPartitions("document_id", "pos")
    placed = ordered.mapInArrow(run, "document_id long, pos int, start_page int, level int, parent_pos int, following int")
    ends = lines.groupBy("document_id").agg(F.max("page_number").alias("last_page"))
    page = F.floor(F.col("following") / 40).cast("int") + 1
    return placed.join(ends, "document_id").select("document_id", "pos", "level", "parent_pos", "start_page", F.when(F.col("following").isNull(), F.col("last_page")).otherwise(F.greatest("start_page", page)).alias("end_page"))


def packed(chunks: DataFrame, most: int) -> DataFrame:
    """document_id, chunk, text, token_count: sentences in order, a new chunk where the next would go beyond `most` tokens.

    Whether a sentence starts a chunk depends on the one before, so rows of a document go through in order;
    they stream, sorted, and only the chunk that grows is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, number, held, size = None, 0, [], 0
        for batch in batches:
            out: list[tuple] = []
            for d, s, n in zip(batch.column("document_id").to_pylist(), batch.column("chunk_text").to_pylist(), batch.column("token_count").to_pylist(), strict=True):
                if held and (d != doc or size + n > most):
                    out.append((doc, number, " ".join(held), size))
                    number, held, size = number + 1, [], 0
                if d != doc:
                    doc, number = d, 0
                held.append(s)
                size += n
            yield table(out)
        if held:
            yield table([(doc, number, " ".join(held), size)])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        d, k, t, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["document_id", "chunk", "text", "token_count"])

    ordered = chunks.select(F.col("document_id").cast("long").alias("document_id"), "pos", "chunk_text", F.col("token_count").cast("long").alias("token_count")).repartition("document_id").sortWithinPartitions("document_id", "pos")
    return ordered.mapInArrow(run, "document_id long, chunk int, text string, token_count long")


def heading_scores(lines: DataFrame) -> DataFrame:
    """How much a line looks like a heading: blank neighbours, title case, few words, a question mark."""
    w = Window.partitionBy("document_id").orderBy("pos")
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 2).otherwise(0)
    line, share = F.col("line"), T.title_case_share(F.col("line"))
    scored = lines.withColumn("around", blank(F.lag("line").over(w)) + blank(F.lead("line").over(w))).where("line <> ''")
    score = F.col("around") + F.when(share >= 0.8, 3).when(share >= 0.5, 2).otherwise(0) + F.when(F.size(T.extract_all(line, r"\S+")) <= 6, 2).otherwise(0) + F.when(line.contains("?"), 2).otherwise(0)
    return scored.select("document_id", "pos", score.cast("int").alias("score"))


def slide_titles(blocks: DataFrame) -> DataFrame:
    """document_id, page_number, title of blocks(document_id, page_number, block_id, kind, y, font_size, text): a slide's placeholder; else its largest text that is neither noise nor a sentence, unless that is long; else the topmost of those that aren't; null where there is none."""
    t, at = F.col("text"), F.struct(F.coalesce("y", F.lit(0.0)), "block_id")
    fits = ~R.is_noise_page(t) & ~R.is_sentence_page(t)
    size = F.struct(-F.coalesce("font_size", F.lit(12.0)), at)
    best = lambda c, order, name: F.min_by(F.when(c, t), F.when(c, order)).alias(name)
    short = F.length(t) <= LONGEST_TITLE
    found = blocks.where(F.trim(t) != "").groupBy("document_id", "page_number").agg(best(F.col("kind") == "SLIDE_TITLE", at, "holder"), best(fits, size, "largest"), best(fits & short, at, "topmost"))
    return found.select("document_id", "page_number", F.coalesce("holder", F.when(F.length("largest") <= LONGEST_TITLE, F.col("largest")), "topmost").alias("title"))
