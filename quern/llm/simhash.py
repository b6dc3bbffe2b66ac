"""SimHash near copies by covering locality-sensitive hashing, exact within the radius.

1. Fingerprints. A text's 3-word shingles, repeats included, are hashed (XXH64, seed
   42); a bit of the fingerprint is 1 where over half of the hashes have it. Rows with one
   fingerprint are one node from here on, so copies never meet each other.
2. Covering masks. Each bit has one of the 2^(r+1) - 1 vectors of r + 1 bits that
   aren't zero, dealt evenly; table v keeps the bits whose vector has an odd product
   with v. Two fingerprints that differ in r bits or fewer have r vectors there, some
   v is orthogonal to all of them, and in its table the two have the same key. So
   every pair within the radius collides; 7 tables of 36 or 37 bits for r = 2.
3. Buckets of more than BUCKET members are covered again, by tables over the bits that
   their table leaves open. What remains open is 12 bits at most, so no bucket has more
   than 4,096 members, whatever the input. Their number is counted before rows move.
4. Within a bucket each member links to the least one that it reaches there, so a bucket
   gives a star, never all of its pairs; the stars' components are those of the links.

Only fingerprints are shuffled. Nothing is collected.

Defined results: a null or empty text, and one without words, has the fingerprint zero
and links like any other; fewer words than three are one shingle. Each row is a document;
rows with the same doc_id, or none, have a result each. component_id is null only where
all doc_ids reached are. Further columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import blocks
from quern.llm.common import discard, partitions, scratch, written
from quern.llm.jaccard import components

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Buckets of more members are covered again.
BUCKET = 1024
#: The most hot buckets whose keys are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Hashes whose bits are counted at a time.
STEP = 1 << 16


def fingerprint(text: str) -> int:
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z and the six white-space characters of ASCII only
    k = min(WORDS, len(words))
    if not k:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - k + 1]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def covering(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over these bits such that any `radius` of the bits are outside one of them."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << p for k, p in enumerate(positions) if ((k % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


TABLES = covering(list(range(BITS)))
#: For each table, masks that keep its bits and cover those that it leaves open.
WITHIN = [[table | m for m in covering([p for p in range(BITS) if not table >> p & 1])] for table in TABLES]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits, as a long) of every row of docs(doc_id, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([signed(fingerprint(t)) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def least_reached(values: np.ndarray, mask: int, radius: int = RADIUS) -> np.ndarray:
    """For each of these distinct sorted fingerprints, which agree on mask, the place of the least that it reaches by steps within the radius."""
    n = len(values)
    if n <= 2 * BUCKET // 3:
        a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius, 1))
    else:  # neighbours are looked up: the open bits are few
        open_bits = [1 << p for p in range(BITS) if not mask >> p & 1]
        steps = [sum(c) for r in range(1, radius + 1) for c in combinations(open_bits, r)]
        found = []
        for step in steps:
            other = values ^ np.uint64(step)
            at = np.minimum(np.searchsorted(values, other), n - 1)
            hit = np.flatnonzero((values[at] == other) & (at > np.arange(n)))
            found.append((hit, at[hit]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    label = np.arange(n)
    while len(a):
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label


def stars(buckets: DataFrame) -> DataFrame:
    """x, y: each member of a bucket (t, u, key, fp) with the least that it reaches there, where that is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by bucket: a bucket is a run of rows, of a bounded length
        held: list[np.ndarray] | None = None

        def links(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            t, u, key, fp = cols
            edge = np.flatnonzero((t[1:] != t[:-1]) | (u[1:] != u[:-1]) | (key[1:] != key[:-1])) + 1
            xs, ys = [], []
            for i, j in zip([0, *edge], [*edge, len(fp)], strict=True):
                if j - i > 1:
                    values = np.sort(fp[i:j].view(np.uint64))
                    mask = TABLES[t[i]] if u[i] < 0 else WITHIN[t[i]][u[i]]
                    label = least_reached(values, mask)
                    moved = np.flatnonzero(label != np.arange(len(values)))
                    xs.append(values[moved].view(np.int64))
                    ys.append(values[label[moved]].view(np.int64))
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("t", "u", "key", "fp")]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            differs = np.zeros(len(cols[0]), bool)
            for c in cols[:3]:
                differs |= c != c[-1]
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if last:
                yield from links([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield from links(held)

    dealt = buckets.repartition(partitions(buckets.sparkSession), "t", "u", "key").sortWithinPartitions("t", "u", "key")
    return dealt.mapInArrow(run, "x long, y long")


def covered(nodes: DataFrame, bucket: int = BUCKET, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The buckets that the distinct fingerprints of nodes(fp) share: t, u (-1, or the table within), key, fp."""
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(TABLES)))
    rows = nodes.select("fp", F.inline(tables))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = written(sizes.where(F.col("n") > bucket).select("t", "key", F.lit(True).alias("hot")), "hot")
    few = hot.limit(broadcast_rows + 1).count() <= broadcast_rows
    marked = rows.join(F.broadcast(hot) if few else hot, ["t", "key"], "left")
    within = F.array(*(F.struct(F.lit(k).alias("u"), F.element_at(F.array(*(F.lit(signed(WITHIN[t][k])) for t in range(len(TABLES)))), F.col("t") + 1).bitwiseAND(F.col("fp")).alias("key")) for k in range(len(TABLES))))
    plain = F.array(F.struct(F.lit(-1).alias("u"), F.col("key")))
    return marked.select("t", "fp", F.explode(F.when(F.col("hot"), within).otherwise(plain)).alias("b")).select("t", "b.u", "b.key", "fp")


def linked(docs: DataFrame) -> DataFrame:
    """A row for every row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    folder = scratch(docs.sparkSession, "simhash")
    rows = written(fingerprints(docs), "fingerprints", folder)
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes", folder)
    links = written(stars(covered(nodes.select("fp"))).distinct(), "links", folder)
    comp = components(links, folder)
    every = written(nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp")), "components", folder)
    least = every.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = every.join(least, "comp").select("fp", "component_id")
    out = rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    out = written(out, "simhash")
    discard(docs.sparkSession, folder)
    return out
