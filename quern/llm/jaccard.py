"""Exact Jaccard join of documents as sets of word shingles, in a metric space of pivots.

Two documents link when 100 * |A and B| >= 75 * |A or B|, so when their Jaccard
distance, a metric, is at most 0.25.

1. Sets. A document's distinct 5-word shingles are hashed to 64 bits; documents
   with the same set are one node from here on, so copies never meet each other.
2. Regions. Sets that share no shingle are at distance 1 from each other and from
   every pivot: no pivot can part them. A linked pair shares one of the first
   floor(n / 4) + 1 shingles of either set in any fixed order; a region is the sets
   that have a shingle among those (and a few more, see too_own). The order is by a count sketch over all
   documents, rarest first, so that shared passages seldom make regions.
3. Pivots. A region's pivot is the member with the fewest shingles before the region's:
   copies with edits of their own have rare ones there, so it is the one nearest to
   what the others have in common. The exact distance
   of every member to it is taken, unless lengths or positions rule a link out.
   Members within 0.25 are one component with the pivot: their mutual pairs need no
   look. Between the others the triangle inequality leaves windows: x and y can link
   only if |d(x, p) - d(y, p)| <= 0.25. A pair that meets in several regions is
   compared in one: each member knows its regions just before, and where the two have
   one of those in common, this region leaves the pair to it.
4. Recursion. Regions whose members are still of several components get more pivots,
   eightfold each round, compared across components and within windows only; used
   pivots leave. It ends when every region is one component or used up, so that no
   link between components is lost.

Distances are computed from the sets in a store of their own, written once and read
by offset, so pairs carry no sets through a shuffle. Nothing is collected.

Defined results: null and empty texts, and texts without words, have no shingles
and are linked with nothing; fewer words than five make one shingle. Each row is a
document; equal rows link. component_id is null only where all doc_ids reached are.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.bpe import blocks
from quern.llm.common import discard, open_in, open_out, partitions, scratch, worker_state, written

WORDS, PERCENT = 5, 75
#: A prefix of n // 4 + 1 shingles would do for regions; one of 2n / 7 + SLACK also lets a set's own shingles rule links out.
SLACK = 4
#: Regions up to this size compare all their members in the first round of the recursion.
SMALL = 9
#: So many of the mixed regions before each of a set's are known there: a pair that shares one of them is compared in that one.
EARLIER = 2
#: Counters of the sketch: 16 bits each, so 8 MB at any size of the input.
SKETCH_BITS = 22
#: Entries of a worker's memo of words.
MEMO = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * MIX


def shingles(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's shingles, in order, repeats included."""
    import xxhash

    memo: dict[bytes, int] = worker_state("jaccard", dict)
    if len(memo) > MEMO:
        memo.clear()
    words = [t.encode().lower().split() for t in texts]  # bytes: A-Z and the six white-space characters of ASCII only
    new = set()
    for w in words:
        new.update(w)
    memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in new - memo.keys())
    out = []
    for w in words:
        h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
        k = min(WORDS, len(h))
        if not k:
            out.append(h)
            continue
        code = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            code = code * MIX + mix(h[i : i + len(code)])
        out.append(mix(code))
    return out


def sketch(docs: DataFrame) -> np.ndarray:
    """About how many shingles fall on each counter; one array of fixed size, added up in pieces on the executors."""
    pieces, width = 64, (1 << SKETCH_BITS) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for _, texts in blocks(batches):
            if codes := shingles(texts):
                total += np.bincount((np.concatenate(codes) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(pieces, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["piece", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total = np.zeros(width, np.uint32)
        for batch in batches:
            for b in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(b.as_py()), np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())], ["piece", "counts"])

    kind = "piece int, counts binary"
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(count, kind).groupBy("piece").applyInArrow(add, kind).collect()  # 64 rows
    out = np.zeros((pieces, width), np.uint16)
    for r in rows:
        out[r.piece] = np.frombuffer(r.counts, np.uint16)
    return out.reshape(-1)


def pack(u: np.ndarray) -> bytes:
    """A sorted set with the upper six bytes of each hash: enough to compare two sets, which differ in far fewer than 2**24 places."""
    return np.ascontiguousarray(u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def sets_of(docs: DataFrame, folder: str) -> DataFrame:
    """For every row: doc_id, n (size of the set), cid (its hash), prefix (its shingles that make regions), file and at (where the set lies). A set that a task meets again lies where it did, without a prefix."""
    order = docs.sparkSession.sparkContext.broadcast(sketch(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        np.seterr(over="ignore")
        counts, out, path, where = order.value, None, f"{folder}/files/{uuid.uuid4().hex}", 0  # a name for each attempt; the written rows name the files that count
        met: dict[int, int] = {}
        for ids, texts in blocks(batches):
            out = out or open_out(path)
            n, cid, prefix, at = [], [], [], []
            if len(met) > MEMO:
                met.clear()
            for codes in shingles(texts):
                u = np.unique(codes)
                n.append(len(u))
                cid.append(int((mix(u + MIX).sum() * MIX ^ np.uint64(len(u))).astype(np.int64)))
                if cid[-1] in met:
                    prefix.append(u[:0].view(np.int64))
                    at.append(met[cid[-1]])
                    continue
                met[cid[-1]] = where
                rank = np.argsort((counts[u >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(48)) | (u >> np.uint64(16)), kind="stable")
                prefix.append(u[rank[: len(u) * 2 // 7 + SLACK]].view(np.int64))
                at.append(where)
                where += out.write(pack(u)) or 6 * len(u)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array([path] * len(ids)), pa.array(at, pa.int64())], ["doc_id", "n", "cid", "prefix", "file", "at"])
        if out:
            out.close()

    return written(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long, cid long, prefix array<long>, file string, at long"), "sets", folder)


def regions(sets: DataFrame, folder: str) -> DataFrame:
    """The members of every region of two sets or more, each with the region's pivot: s, cid, n, pos, pivot, pivot_n, pivot_pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by s, pos, a hash, cid: a region is a run. Of the last run only its first member and whether it has two are kept.
        names = ["s", "cid", "n", "pos"]
        first, last_cid, many = None, None, False  # first member of the run at the end of what was read
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if not len(cols[0]):
                continue
            held = first is not None and not many
            if first is not None:
                cols = [np.concatenate([[f], c]) for f, c in zip(first, cols, strict=True)]
            s, cid = cols[0], cols[1]
            new = np.r_[True, (s[1:] != s[:-1]) | (cid[1:] != cid[:-1])]
            if first is not None and last_cid is not None and len(s) > 1:
                new[1] = (s[1] != s[0]) or (cid[1] != last_cid)
            cols = [c[new] for c in cols]
            s = cols[0]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            run = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
            size = np.bincount(run)
            two = size >= 2
            was_many = many
            if was_many:
                two[0] = True
            keep = two[run]
            if first is not None and not held:
                keep[0] = False  # went out before
            pick = starts[run[keep]]
            out = [c[keep] for c in cols] + [cols[k][pick] for k in (1, 2, 3)]
            end = starts[-1]
            many = bool(size[-1] >= 2 or (was_many and len(size) == 1))
            first, last_cid = [c[end] for c in cols], int(batch.column("cid")[-1].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [*names, "pivot", "pivot_n", "pivot_pos"])

    postings = sets.where("size(prefix) > 0").select("cid", "n", F.posexplode_outer("prefix").alias("pos", "s")).select("s", "cid", "n", F.col("pos").cast("long").alias("pos"))
    dealt = postings.repartition(partitions(sets.sparkSession), "s").sortWithinPartitions("s", "pos", F.xxhash64("cid"), "cid")
    return written(dealt.mapInArrow(run, "s long, cid long, n long, pos long, pivot long, pivot_n long, pivot_pos long"), "regions", folder)


def may_link(n, pos, n2, pos2):
    """The length and positional bounds: with a shared shingle at these places, what the sets can have in common at most."""
    common = F.least(pos, pos2) + 1 + F.least(n - pos - 1, n2 - pos2 - 1)
    return (100 * F.least(n, n2) >= PERCENT * F.greatest(n, n2)) & (100 * common >= PERCENT * (n + n2 - common))


def prefix_of(n):
    return F.least(n, F.floor(n * 2 / 7) + SLACK)


def lacks(n, n2):
    """How many of its shingles a set of size n may lack in one of size n2 that it links to."""
    return n - F.ceil(PERCENT * (n + n2) / (100 + PERCENT))


def reach(n, n2):
    """The places from the start at which a shingle of one set that the other has must be in the prefix of the other, of size n2, if they link: else all of its prefix, but for as many as come before, would be missing from the first."""
    return prefix_of(n2) - lacks(n2, n)


def too_own(n, own, n2):
    """Whether a set's own shingles rule out a link with a set of size n2, exactly.

    own: so many of its shingles within reach(n, n) are in no region of more than SMALL sets. Sets that
    meet in a small region are compared there; others share none of these, so a link lacks them all.
    """
    return F.least(own - F.greatest(reach(n, n) - reach(n, n2), F.lit(0)), reach(n, n2)) > lacks(n, n2)


def distances(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """x, y, common, n, n2 of pairs of sets, from the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, sets = {}, {}

        def get(file: str, at: int, n: int) -> np.ndarray:
            if (file, at) not in sets:
                if len(sets) > 500:
                    sets.clear()
                if file not in files:
                    if len(files) > 200:
                        files.clear()
                    files[file] = open_in(file)
                sets[file, at] = unpack(files[file].read_at(6 * n, at))
            return sets[file, at]

        for batch in batches:
            common = []
            for f, a, n, f2, a2, n2 in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n", "file2", "at2", "n2")), strict=True):
                u, v = sorted((get(f, a, n), get(f2, a2, n2)), key=len)
                common.append(int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(common, pa.int64()), batch.column("n"), batch.column("n2")], ["x", "y", "common", "n", "n2"])

    where = index.select("cid", "file", "at", "n")
    other = where.toDF("y", "file2", "at2", "n2")
    return pairs.join(where.withColumnRenamed("cid", "x"), "x").join(other, "y").mapInArrow(run, "x long, y long, common long, n long, n2 long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, comp (the smallest node reachable) of the nodes of edges(x, y): smallest labels of neighbours, and of labels, until nothing changes."""
    both = written(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges", folder)
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("comp")), "labels", folder)
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        better = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        jump = better.join(labels.select(F.col("node").alias("new"), F.col("comp").alias("far")), "new", "left")
        after = written(jump.select("node", F.col("comp").alias("old"), F.least("new", F.coalesce("far", "new")).alias("comp")), "labels", folder)
        labels = after.select("node", "comp")
        if not after.where("old <> comp").limit(1).count():
            return labels


def linked(docs: DataFrame) -> DataFrame:
    """A row for every row of docs(doc_id, text): doc_id, n_shingles, component_id."""
    folder = scratch(docs.sparkSession, "jaccard")
    sets = sets_of(docs, folder)
    index = written(sets.where("n > 0").groupBy("cid").agg(F.min(F.struct("file", "at", "n")).alias("w")).select("cid", "w.*"), "index", folder)
    members = regions(sets, folder)
    ordered = lambda a, b: [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]
    near = 100 * F.col("common") >= PERCENT * (F.col("n") + F.col("n2") - F.col("common"))
    # the first pivots
    first = members.where((F.col("cid") != F.col("pivot")) & may_link(F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos")))
    known = written(distances(first.select(*ordered(F.col("cid"), F.col("pivot"))).distinct(), index), "distances", folder)
    links = known.where(near).select("x", "y")
    comp = components(links, folder)
    # regions of several components go on, each member with its component; sets of the others are settled
    label = comp.select(F.col("node").alias("cid"), F.col("comp").alias("c"))
    region, own = Window.partitionBy("s"), Window.partitionBy("cid")
    several = lambda rows, *more: rows.select("*", F.min("c").over(region).alias("a"), F.max("c").over(region).alias("b"), *more).where("a <> b").drop("a", "b")
    rows = members.select("s", "cid", "n", "pos", "pivot").join(label, "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    rows = written(several(rows, (F.count(F.lit(1)).over(region) > SMALL).alias("large")), "mixed", folder)
    # each member's distance to the pivot, how many of its shingles are its own (outside mixed regions of more than SMALL sets),
    # and its regions just before: a pair that shares several regions is compared in one, as where it shares one of those before, it was or will be
    far = known.select("x", "y", (1 - F.col("common") / (F.col("n") + F.col("n2") - F.col("common"))).alias("d"))
    asked = first.select("cid", "pivot", *ordered(F.col("cid"), F.col("pivot"))).distinct().join(far, ["x", "y"])
    rows = rows.join(asked.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("pivot", "d"))).alias("ds")), "cid", "left")
    before = own.orderBy("pos", "s")
    rows = rows.select(
        "s", "cid", "n", "pos", "large", "c", "pivot", F.try_element_at("ds", F.col("pivot")).alias("d"), (reach(F.col("n"), F.col("n")) - F.count_if(F.col("large") & (F.col("pos") < reach(F.col("n"), F.col("n")))).over(own)).alias("own"),
        F.array_compact(F.array(*(F.lag("s", k).over(before) for k in range(1, EARLIER + 1)))).alias("earlier"), F.xxhash64("cid").alias("rank"),
    )
    rows = rows.where("cid <> pivot").drop("pivot")
    width = SMALL - 1
    while True:
        turn = F.row_number().over(region.orderBy("pos", "rank", "cid"))
        ranked = written(several(rows, turn.alias("k")), "rounds", folder)
        if not ranked.limit(1).count():
            break
        pivots = ranked.where(F.col("k") <= width).select("s", F.col("cid").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("pp"), F.col("own").alias("po"), F.col("d").alias("pd"), F.col("c").alias("pc"), F.col("earlier").alias("pe"))
        window = F.coalesce(F.abs(F.col("d") - F.col("pd")) <= 0.25 + 1e-9, F.lit(True))
        once = (F.col("k") > width) | (F.col("cid") < F.col("p"))
        pairs = ranked.join(pivots, "s").where(once & (F.col("c") != F.col("pc")) & ~F.arrays_overlap("earlier", "pe") & window & may_link(F.col("n"), F.col("pos"), F.col("pn"), F.col("pp")) & ~(F.col("large") & (too_own(F.col("n"), F.col("own"), F.col("pn")) | too_own(F.col("pn"), F.col("po"), F.col("n")))))
        fresh = pairs.select(*ordered(F.col("cid"), F.col("p"))).distinct().join(known.select("x", "y"), ["x", "y"], "left_anti")
        more = written(distances(fresh, index), "distances", folder)
        known = known.unionByName(more)
        if more.where(near).limit(1).count():
            links = links.unionByName(more.where(near).select("x", "y"))
            comp = components(links, folder)
        label = comp.select(F.col("node").alias("cid"), F.col("comp").alias("c"))
        left = ranked.where(F.col("k") > width).drop("k", "c")
        rows = left.join(label, "cid", "left").withColumn("c", F.coalesce("c", "cid"))
        width *= 8
    every = sets.select("doc_id", "n", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = every.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = every.where("n > 0").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = written(out.unionByName(every.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "linked")
    discard(docs.sparkSession, folder)
    return out
