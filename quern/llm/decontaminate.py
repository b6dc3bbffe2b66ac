"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window of an item is a set of positioned shingles of GRAM words, and a document
holds the window if it holds all of them in place. For containment of the whole
set the prefix filter needs one token: the rarest shingle of each window, by its
count over all documents. So:

1. one pass over the documents keeps the places of shingles that the benchmark
   has, each with the words around it (long enough for any window over it);
2. these places give the counts, and so each window's rarest shingle;
3. places join windows on that shingle; the length and positional bounds drop
   places where the window can't fit; the words are then compared in full.

The benchmark's distinct shingles are broadcast only up to BROADCAST_ROWS of
them (8 bytes each); beyond it places and shingles meet by a shuffle, without
the words, which join the places that are wanted. Copies of a shingle's text
never meet each other: every join is from places to the benchmark.

Defined results: a null or empty text, and one without words, has n_words 0 and
no hits. Rows with the same doc_id, or none, are judged one by one. Items
without words, or whose item_id is null, take no part; items of the same id
count as one, and every window of each of their texts is searched; items of the
same text each count. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import ascii_lower, written

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 4_000_000
# Fixed value: what separates words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), lambda w: w != "")


def grams_of(hashes: Column, n: int) -> Column:
    """The hash of each run of n words, by where it starts; empty with fewer words."""
    count = F.size(hashes) - n + 1
    run = lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, n)))
    return F.transform(F.slice(hashes, F.lit(1), F.greatest(count, F.lit(0))), run)


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, w (number of the window), words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("all")).where("item_id is not null and size(all) > 0")
    n = F.greatest(F.size("all") - window, F.lit(0))
    return items.select("item_id", "all", F.explode_outer(F.sequence(F.lit(0), n)).alias("w")).select("item_id", "w", F.slice("all", F.col("w") + 1, window).alias("words"))


def context_of(window: int, gram: int, n: int) -> list[Column]:
    """before and context of a row with words and pos: the words around a shingle of n words, enough for any window over it."""
    most = window - gram if n == gram else 0
    before = F.least(F.col("pos"), F.lit(most))
    return [before.alias("before"), F.slice("words", F.greatest(F.col("pos") - before + 1, F.lit(1)), before + n + most).alias("context")]


def places_of(docs: DataFrame, grams: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """For each row of docs one row with pos null, and one for each place of a wanted shingle: rid, doc_id, n_words, len, gram, pos, before (words of the context ahead of the place), context."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    few = grams.count() <= BROADCAST_ROWS
    if lengths and not few:
        return shuffled_places(written(base, "words"), grams, lengths, window, gram)
    hashed = base.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    wanted = [grams.where(F.col("len") == n).select(F.col("gram").alias("wanted")) for n in lengths]
    out = rows_of(hashed) if not lengths else None
    for k, n in enumerate(lengths):
        # the first length also carries the row of the document itself, as an added element at -1
        marks = F.concat(F.array(F.lit(0).cast("long")), grams_of(F.col("h"), n)) if k == 0 else grams_of(F.col("h"), n)
        # the marks are a column of their own, so that the explode is compiled and doesn't copy the words for each row;
        # an outer explode has no filter on the array's size, which would compute the array once more
        spread = hashed.withColumn("marks", marks).select("rid", "doc_id", "words", F.posexplode_outer("marks").alias("pos", "gram"))
        if k == 0:
            spread = spread.withColumn("pos", F.col("pos") - 1)
        found = spread.join(F.broadcast(wanted[k]), (F.col("gram") == F.col("wanted")) & (F.col("pos") >= 0), "left" if k == 0 else "inner")
        found = found.where((F.col("pos") < 0) | F.col("wanted").isNotNull())
        there = lambda c, name: F.when(F.col("pos") >= 0, c).alias(name)
        before, context = context_of(window, gram, n)
        found = found.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), there(F.lit(n), "len"), there(F.col("gram"), "gram"), there(F.col("pos"), "pos"), there(before, "before"), there(context, "context"))
        out = found if out is None else out.unionByName(found)
    return out


def rows_of(base: DataFrame) -> DataFrame:
    """The row of each document, without a place."""
    none = {"len": "int", "gram": "long", "pos": "int", "before": "int", "context": "array<string>"}
    return base.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), *(F.lit(None).cast(kind).alias(c) for c, kind in none.items()))


def shuffled_places(base: DataFrame, grams: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """The same for a benchmark of any size, from a written base(rid, doc_id, words): only (rid, pos, gram) meets the benchmark by a shuffle; what is wanted then joins its words, once."""
    hashed = base.select("rid", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    out = rows_of(base)
    for n in lengths:
        spread = hashed.withColumn("marks", grams_of(F.col("h"), n)).select("rid", F.posexplode_outer("marks").alias("pos", "gram")).where("gram is not null")
        wanted = grams.where(F.col("len") == n).select("gram")
        found = spread.join(wanted, "gram", "left_semi").join(base, "rid")
        out = out.unionByName(found.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), F.lit(n).alias("len"), "gram", "pos", *context_of(window, gram, n)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row for each row of docs(doc_id, text): rid (a number for the row), doc_id, n_words, n_hit, items (sorted strings)."""
    windows = written(windows_of(benchmark, window), "windows")
    least = F.least(F.size("words"), F.lit(gram))
    hashes = windows.select("item_id", "w", "words", least.alias("len"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    lengths = sorted(r.len for r in hashes.select("len").distinct().collect())  # at most `gram` of them
    by_length = F.coalesce(*(F.when(F.col("len") == n, grams_of(F.col("h"), n)) for n in lengths)) if lengths else F.array(F.lit(0).cast("long"))
    parts = hashes.withColumn("grams", by_length).select("item_id", "w", "words", "len", F.posexplode_outer("grams").alias("offset", "gram"))
    places = written(places_of(docs, parts.select("len", "gram").distinct(), lengths, window, gram), "places")
    counts = places.where("pos is not null").groupBy("len", "gram").agg(F.count(F.lit(1)).alias("n"))
    # each window's prefix: its rarest shingle; a window whose shingles don't all occur can't occur
    # windows of the same words are one, whichever items have them
    ranked = parts.join(counts, ["len", "gram"], "left").groupBy("len", F.col("words").alias("want")).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("offset"), F.col("gram"))).alias("rare"))
    prefix = ranked.where("rare.n > 0").select("len", F.col("rare.gram").alias("gram"), F.col("rare.offset").alias("offset"), "want")
    owners = windows.select("item_id", F.col("words").alias("want")).distinct()
    start = F.col("pos") - F.col("offset")
    fits = (F.col("offset") <= F.col("before")) & (start + F.size("want") <= F.col("n_words"))
    same = F.slice("context", F.greatest(F.col("before") - F.col("offset") + 1, F.lit(1)), F.size("want")) == F.col("want")
    hits = written(places.where("pos is not null").join(prefix, ["len", "gram"]).where(fits & same).select("rid", start.alias("start"), F.size("want").alias("size"), "want"), "hits")
    # words covered by overlapping windows count once
    spans = hits.select("rid", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    ahead = F.max("end").over(Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("from", F.greatest(F.col("start"), F.coalesce(ahead, F.lit(0)))).groupBy("rid").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    items = hits.select("rid", "want").distinct().join(owners, "want").groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = places.where("pos is null").select("rid", "doc_id", "n_words")
    return rows.join(covered, "rid", "left").join(items, "rid", "left").select("rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    joined = F.array_join("items", ",")
    return contaminated(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
