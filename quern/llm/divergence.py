"""Audit of how the sources of a language diverge, in exact integers.

1. Counts. One pass over the texts counts each term within (lang, source), first in each
   task; the partial counts are dealt by (lang, term), so one shuffle gives the counts, each
   term's documents and its count in the language. Terms in LEAST documents stay.
2. Pairs. f of a source against another is summed over all kept terms, also those that
   neither has. Those all have one value, the baseline; the sum is V times it, plus what
   the terms of either source change, plus what those of both change beyond that. A source's
   terms of one count change it alike, so they go in as (count, number of terms); only
   terms that both have are joined.
3. Ranks by radix selection. Histograms over DIGIT bits of the values, from the highest,
   find for each group the digit in which its k-th value lies; rows above it are in, rows
   below it out, those in it go to the next digit. Rows that tie in all bits are told apart
   by histograms over the bytes of the term that come after what they share. It ends once
   every group has FEW rows undecided; only those and the rows that are in are sorted.

Only terms' counts, histograms and pairs of sources are shuffled. A group that holds a
third of all terms is split over its terms; the cuts of the groups are broadcast
up to BROADCAST_ROWS of them, and joined by a shuffle beyond.

Defined results: null text, lang and source count as ''; a group without terms has its
pairs, and no terms; a language without kept terms has pairs of value 0. Rows with the
same doc_id, or none, are documents each. Further columns are ignored; a table without
rows gives none.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.bpe import blocks
from quern.llm.common import discard, scratch, written

LEAST, TOP, UNIT = 3, 200, 1_000_000_000
#: Bits, and bytes, of a digit; rows of a group that are sorted without more digits.
DIGIT, BYTES, FEW = 12, 2, 1000
#: Distinct terms that a task counts at a time.
MEMO = 500_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 22
BROADCAST_ROWS = 100_000
#: Lower-cases A-Z and blanks all else of ASCII but a-z.
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
GROUP = ["lang", "source"]


def pieces(letters: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length."""
    at = 0
    while at < len(letters):
        end = letters.find(b" ", at + PIECE)
        end = len(letters) if end < 0 else end
        yield letters[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents): sums so far, several rows for a term. Each group also has rows without a term."""

    names = [*GROUP, "term", "n", "d"]

    def rows(group: tuple[str, str], terms: list, n: list[int], d: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([g] * len(terms), pa.string()) for g in group), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, groups, size = defaultdict(lambda: (Counter(), Counter())), set(), 0

        def out() -> Iterator[pa.RecordBatch]:
            for group, (n, d) in seen.items():
                if n:
                    yield rows(group, [t.decode() for t in n], list(n.values()), [d[t] for t in n])

        for named, texts in blocks(batches):
            for group, text in zip(named, texts, strict=True):
                group = (group["lang"], group["source"])
                groups.add(group)
                n, d = seen[group]
                size -= len(n)
                met = set()
                for words in pieces(text.encode().translate(LETTERS)):
                    n.update(words)
                    met.update(words)
                d.update(met)
                size += len(n)
            if size > MEMO:
                yield from out()
                seen.clear()
                size = 0
        yield from out()
        for group in groups:
            yield rows(group, [None], [0], [0])

    named = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP))
    return docs.select(named.alias("named"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, d long")


def share(count: str, total: str) -> str:
    """SQL for 1 + floor(UNIT * (count + 1) / (total + v)), exactly."""
    return f"(1 + cast({count} + 1 as decimal(20,0)) * {UNIT}BD div cast({total} + v as decimal(20,0)))"


def gap(p: str, q: str) -> str:
    """SQL for floor((p - q)^2 / q); both are 1 to UNIT + 1, so the square fits a long."""
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def few(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast if it has BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def measured(docs: DataFrame, least: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """groups: lang, source, v, p0 (of a term that the source doesn't have; null where v is 0); cells: lang, source, term, p, p0, q, for each kept term of a source."""
    term = Window.partitionBy("lang", "term")
    sums = counted(docs).repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    sums = sums.select(*GROUP, "term", "n", F.sum("d").over(term).alias("in_docs"), F.sum("n").over(term).alias("in_lang"), (F.min("source").over(term) == F.col("source")).alias("first"))
    counts = written(sums.where(F.col("term").isNull() | (F.col("in_docs") >= least)), "counts", folder)
    once = F.col("term").isNotNull() & F.col("first")
    groups = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count_if(once).alias("v"), F.sum(F.when(once, F.col("in_lang")).otherwise(0)).alias("lang_total"))
    lang = Window.partitionBy("lang")
    groups = groups.select(*GROUP, "total", F.sum("v").over(lang).alias("v"), F.sum("lang_total").over(lang).alias("lang_total"))
    groups = written(groups.withColumn("p0", F.expr(f"if(v > 0, {share('0', 'total')}, null)")), "groups", folder)
    cells = counts.where("term is not null").join(few(groups), GROUP).selectExpr(*GROUP, "term", f"{share('n', 'total')} p", "p0", f"{share('in_lang', 'lang_total')} q")
    return groups.select(*GROUP, "v", "p0"), written(cells, "cells", folder)


def pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value: f of source against item, summed over all kept terms."""
    key, other = ["lang", "source", "item"], F.col("source") != F.col("item")
    ours, theirs = groups, groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    same = gap("p0", "q0")
    base = ours.join(few(theirs), "lang").where(other).selectExpr(*key, f"if(v > 0, v * {same}, 0) value")
    alike = cells.groupBy(*GROUP, "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    left = alike.join(few(theirs), "lang").where(other).selectExpr(*key, f"m * ({gap('p', 'q0')} - {same}) value")
    right = alike.toDF("lang", "item", "q", "q0", "m").join(few(ours), "lang").where(other).selectExpr(*key, f"m * ({gap('p0', 'q')} - {same}) value")
    mine = cells.select("lang", "term", "source", "p", "p0")
    both = mine.join(mine.toDF("lang", "term", "item", "q", "q0"), ["lang", "term"]).where(other)
    both = both.selectExpr(*key, f"{gap('p', 'q')} - {gap('p', 'q0')} - {gap('p0', 'q')} + {same} value")
    return base.unionByName(left).unionByName(right).unionByName(both).groupBy(*key).agg(F.sum("value").alias("value"))


def shared_start(cuts: DataFrame) -> DataFrame:
    """cuts with low: the bytes that the strings least and most of a group, and so all between, begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            low = [None if x is None else os.path.commonprefix([x, y]) for x, y in zip(b.column("least").to_pylist(), b.column("most").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*GROUP, "need")), pa.array(low, pa.binary())], [*GROUP, "need", "low"])

    return cuts.select(*GROUP, "need", "least", "most").mapInArrow(run, "lang string, source string, need long, low binary")


def top_ranked(rows: DataFrame, top: int, folder: str) -> DataFrame:
    """The first `top` rows(lang, source, item, value) of each group, value descending, then item ascending by its UTF-8 bytes; values are below 2^60, items of a group distinct."""
    group, shift = Window.partitionBy(*GROUP), 60
    cuts = written(rows.select(*GROUP).distinct().selectExpr(*GROUP, f"cast({top} as long) need", "0L prefix", "cast(null as long) left_over"), "cuts", folder)
    crowded = False
    while shift > 0:
        # of the rows whose bits so far are the group's, a histogram of the next ones
        before, shift = shift, max(0, shift - DIGIT)
        at = rows.join(few(cuts), GROUP).where(F.shiftright("value", before) == F.col("prefix"))
        digits = at.groupBy(*GROUP, "need", "prefix", F.shiftright("value", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        digits = digits.withColumn("upto", F.sum("n").over(group.orderBy(F.desc("digit"))))
        # the digit in which the k-th value lies; with fewer rows than k, all of them are in
        reached = digits.where("upto >= need").groupBy(*GROUP).agg(F.max_by(F.struct(F.col("digit").alias("prefix"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("n").alias("left_over")), "digit").alias("c"))
        lower = F.shiftleft("prefix", before - shift)
        cuts = cuts.join(reached, GROUP, "left").select(*GROUP, F.coalesce("c.need", "need").alias("need"), F.coalesce("c.prefix", lower).alias("prefix"), F.coalesce("c.left_over", F.lit(0).cast("long")).alias("left_over"))
        cuts = written(cuts, "cuts", folder)
        crowded = bool(cuts.where(F.col("left_over") > FEW).limit(1).count())
        if not crowded:
            break
    held = rows.join(few(cuts), GROUP).withColumn("bits", F.shiftright("value", shift)).where("bits >= prefix")
    if not crowded:
        return held.drop("bits", "prefix", "need", "left_over")
    # ties of all bits: digits of bytes
    tied = written(held.where((F.col("left_over") > FEW) & (F.col("bits") == F.col("prefix"))).select(*GROUP, "item", F.encode("item", "utf-8").alias("raw"), "need"), "tied", folder)
    others = written(held.where(~((F.col("left_over") > FEW) & (F.col("bits") == F.col("prefix")))).select(rows.columns), "untied", folder)
    values = cuts.select(*GROUP, F.col("prefix").alias("value"))
    inside = []
    while tied.limit(1).count():
        ends = tied.groupBy(*GROUP, "need").agg(F.min("raw").alias("least"), F.max("raw").alias("most"))
        start = written(shared_start(ends).select(*GROUP, "low"), "cuts", folder)
        at = written(tied.join(few(start), GROUP).select(*GROUP, "item", "raw", "need", F.expr(f"substring(raw, length(low) + 1, {BYTES})").alias("digit")), "tied", folder)
        digits = at.groupBy(*GROUP, "need", "digit").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(group.orderBy("digit")))
        cut = written(digits.where("upto >= need").groupBy(*GROUP).agg(F.min(F.struct("digit", (F.col("need") - F.col("upto") + F.col("n")).alias("rest"), "n")).alias("c")).select(*GROUP, F.col("c.digit").alias("cut"), "c.rest", "c.n"), "cuts", folder)
        now = at.join(few(cut), GROUP)
        here = F.col("digit") == F.col("cut")
        inside.append(now.where((F.col("digit") < F.col("cut")) | (here & (F.col("n") <= FEW))).select(*GROUP, "item"))
        tied = written(now.where(here & (F.col("n") > FEW)).select(*GROUP, "item", "raw", F.col("rest").alias("need")), "tied", folder)
    for more in inside:
        others = others.unionByName(more.join(few(values), GROUP).select(rows.columns))
    return others


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs(text, lang, source)."""
    folder = scratch(docs.sparkSession, "divergence")
    groups, cells = measured(docs, least, folder)
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value)
    over = written(cells.where("p > q").selectExpr(*GROUP, "term item", f"{gap('p', 'q')} value"), "over", folder)
    terms = top_ranked(over, top, folder).select(*GROUP, F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top)
    others = pairs(groups, cells).select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    out = written(others.unionByName(terms), "divergence")
    discard(docs.sparkSession, folder)
    return out
