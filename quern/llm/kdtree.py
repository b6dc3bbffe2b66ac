"""Centroid clustering by the filtering algorithm on kd-trees, in exact integers.

1. Vectors become integers, floor(1024 * x). Each partition cuts its vectors into blocks
   of bounded size and builds a kd-tree over each block (the widest side is halved at the
   median): every node has its count, its sums and its box. The trees are written
   once, a row each; the rounds read them and never shuffle a vector.
2. A round sends the centroids down each tree. In a node, z is the candidate nearest to the
   middle of the box; another candidate is pruned where even the box's corner that is most
   on its side is strictly nearer to z, so a tie is never pruned. A node with one candidate
   left is assigned whole, by its sums; a leaf with several is resolved vector by vector,
   ties to the smaller number.
3. A task adds its trees up, so a round shuffles a row for each task and centroid, and
   the driver gets a row for each centroid.

Arithmetic is exact: on 64-bit floats while all squared distances stay below 2^53, on
Python's integers beyond. In many dimensions boxes are wide and little is pruned; the
result doesn't depend on that.

Defined results: vectors that are null, of another length, or hold null or non-finite
components take no part. Each row is a vector, also with a repeated vec_id or none; rows
without one are clustered but never start a centroid while others are there. With fewer
vectors than centroids each starts one; without any the result is empty. distance is null
where it doesn't fit a long, and so are the inertias that would count it. Further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, scratch, written

SIZE, CENTROIDS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3"
#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 8192, 32
#: Components below this have squared distances that 64-bit floats hold exactly, up to 2^(2 * 23) * SIZE = 2^52.
EXACT = 1 << 22


def whole(x: float) -> int:
    """floor(1024 * x), also where 1024 * x is beyond the floats."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(SCALE * x)


def integers(flat: np.ndarray, size: int) -> np.ndarray:
    """A row of integers for each vector: int64, or Python's integers where some are large."""
    if not len(flat):
        return np.zeros((0, size), np.int64)
    if np.abs(flat).max() < 2.0**38:  # so that the sums of a block fit as well
        return np.floor(flat * SCALE).astype(np.int64).reshape(-1, size)
    return np.array([whole(x) for x in flat.tolist()], object).reshape(-1, size)


def packed(a: np.ndarray) -> tuple[bytes, bool]:
    """The integers as bytes of 8 each, or as decimal text where some are larger; and which."""
    if a.size and max(abs(int(a.max())), abs(int(a.min()))) >= 1 << 62:
        return " ".join(map(str, a.ravel().tolist())).encode(), True
    return a.astype("<i8").tobytes(), False


def unpacked(raw: bytes, large: bool, size: int) -> np.ndarray:
    if large:
        return np.array([int(x) for x in raw.split()], object).reshape(-1, size)
    return np.frombuffer(raw, "<i8").reshape(-1, size)


class Tree:
    """A kd-tree over rows of points. Level k has 2^k nodes; node i of a level has the rows between its bounds."""

    def __init__(self, points: np.ndarray):
        self.points, self.levels = points, self.bounds(len(points))

    @staticmethod
    def bounds(n: int) -> list[np.ndarray]:
        """Where the nodes of each level begin and end: halves of halves, until leaves are small."""
        out = [np.array([0, n])]
        while np.diff(out[-1]).max() > LEAF:
            edge = out[-1]
            out.append(np.sort(np.r_[edge, (edge[:-1] + edge[1:]) // 2]))
        return out

    @classmethod
    def built(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order of its rows."""
        order = np.arange(len(points))
        levels = cls.bounds(len(points))
        for edge in levels[:-1]:
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                mine = points[order[a:b]]
                side = int(np.argmax(mine.max(0) - mine.min(0)))
                order[a:b] = order[a:b][np.argsort(mine[:, side], kind="stable")]
        return cls(points[order]), order

    def nodes(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The sums and the box of each node, by level."""
        at = self.levels[-1][:-1]
        low, high, sums = (f.reduceat(self.points, at, axis=0) for f in (np.minimum, np.maximum, np.add))
        out = [(sums, low, high)]
        for _ in self.levels[:-1]:
            sums, low, high = sums[::2] + sums[1::2], np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            out.append((sums, low, high))
        return out[::-1]


def nearest(points: np.ndarray, centroids: np.ndarray, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest centroid, ties to the smaller number, and the squared distance."""
    d = (points * points).sum(1)[:, None] - 2 * (points @ centroids.T) + (centroids * centroids).sum(1)[None, :]
    if alive is not None:
        d = np.where(alive, d, d.max() + 1)
    best = d.argmin(1) if len(d) else np.zeros(0, np.int64)
    return best, d[np.arange(len(d)), best]


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as floats where all squared distances between them are exact in those, else as Python's integers."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    return [a.astype(np.float64 if most < EXACT else object) for a in arrays]


def filtered(tree: Tree, nodes: list[tuple], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """count and sums (Python's integers) of each centroid's points, and how many points were looked at one by one."""
    k, size = centroids.shape
    count, total = np.zeros(k, np.int64), np.zeros((k, size), object)
    alive = np.ones((1, k), bool)
    open_nodes = np.array([0])
    for depth, (edge, (sums, low, high)) in enumerate(zip(tree.levels, nodes, strict=True)):
        lo, hi, c = exact(low[open_nodes], high[open_nodes], centroids)
        # twice the squared distance to the middle, but for what all candidates share
        middle = (c * c).sum(1)[None, :] - (lo + hi) @ c.T
        z = np.where(alive, middle, middle.max() + 1).argmin(1)
        u = c[None, :, :] - c[z][:, None, :]
        corner = np.maximum(u * hi[:, None, :], u * lo[:, None, :]).sum(2)
        norms = (c * c).sum(1)
        alive = alive & ~(norms[None, :] - norms[z][:, None] - 2 * corner > 0)
        done = alive.sum(1) == 1
        sizes = np.diff(edge)[open_nodes]
        for j in np.flatnonzero(done):
            w = int(alive[j].argmax())
            count[w] += sizes[j]
            total[w] += sums[open_nodes[j]].astype(object)
        open_nodes, alive = open_nodes[~done], alive[~done]
        if not len(open_nodes):
            return count, total, 0
        if depth < len(nodes) - 1:
            open_nodes, alive = np.stack([2 * open_nodes, 2 * open_nodes + 1], 1).ravel(), np.repeat(alive, 2, axis=0)
    edge = tree.levels[-1]
    rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in open_nodes])
    of_leaf = np.repeat(np.arange(len(open_nodes)), np.diff(edge)[open_nodes])
    p, c = exact(tree.points[rows], centroids)
    best, _ = nearest(p, c, alive[of_leaf])
    for w in np.unique(best):
        mine = best == w
        count[w] += int(mine.sum())
        total[w] += tree.points[rows[mine]].sum(0).astype(object)
    return count, total, len(rows)


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id, v (doubles) of the rows of vectors(vec_id, embedding) that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == size) & F.coalesce(finite, F.lit(False)))


def trees(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """A row for each kd-tree: vec_ids, and points, sums, low and high as bytes (large: as text)."""
    names = ["points", "sums", "low", "high"]

    def tree(ids: list, flat: np.ndarray) -> pa.RecordBatch:
        made, order = Tree.built(integers(flat, size))
        nodes = made.nodes()
        parts = [packed(a) for a in (made.points, *(np.concatenate([n[k] for n in nodes]) for k in range(3)))]
        columns = [pa.array([pa.array([ids[i] for i in order], pa.int64())], pa.list_(pa.int64())), *(pa.array([p], pa.binary()) for p, _ in parts), pa.array([[large for _, large in parts]], pa.list_(pa.bool_()))]
        return pa.RecordBatch.from_arrays(columns, ["vec_ids", *names, "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flat, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                ids += some.column(0).to_pylist()
                flat.append(some.column(1).flatten().to_numpy(zero_copy_only=False))
                n += some.num_rows
                if n >= BLOCK:
                    every = np.concatenate(flat)
                    yield tree(ids[:BLOCK], every[: BLOCK * size])
                    ids, flat, n = ids[BLOCK:], [every[BLOCK * size :]], n - BLOCK
        if n:
            yield tree(ids, np.concatenate(flat))

    kind = "vec_ids array<long>, " + ", ".join(f"{c} binary" for c in names) + ", large array<boolean>"
    return kept(vectors, size).mapInArrow(run, kind)


def opened(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, Tree, list[tuple]]]:
    """vec_ids, tree and nodes of each row of trees."""
    for row in range(batch.num_rows):
        large = batch.column("large")[row].as_py()
        points, *nodes = (unpacked(batch.column(c)[row].as_py(), flag, size) for c, flag in zip(("points", "sums", "low", "high"), large, strict=True))
        tree = Tree(points)
        cuts = np.cumsum([len(edge) - 1 for edge in tree.levels])[:-1]
        yield batch.column("vec_ids")[row].as_py(), tree, list(zip(*(np.split(a, cuts) for a in nodes), strict=True))


def totals(forest: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """For each centroid that has points: their count, their sums, and how many points of the tasks that report it were looked at one by one."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, looked = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object), 0
        for batch in batches:
            for _, tree, nodes in opened(batch, size):
                n, s, m = filtered(tree, nodes, centroids)
                count, total, looked = count + n, total + s, looked + m
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(count[has], pa.int64()), pa.array([[str(x) for x in total[w]] for w in has], pa.list_(pa.string())), pa.array([looked if w == has[0] else 0 for w in has], pa.int64())], ["cluster", "n", "sums", "looked"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, looked = 0, [0] * size, 0
        for batch in batches:
            for m, sums, some in zip(*(batch.column(c).to_pylist() for c in ("n", "sums", "looked")), strict=True):
                n, total, looked = n + m, [a + int(b) for a, b in zip(total, sums, strict=True)], looked + some
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([list(map(str, total))], pa.list_(pa.string())), pa.array([looked], pa.int64())], ["cluster", "n", "sums", "looked"])

    kind = "cluster int, n long, sums array<string>, looked long"
    return {r.cluster: (r.n, [int(x) for x in r.sums], r.looked) for r in forest.mapInArrow(run, kind).groupBy("cluster").applyInArrow(add, kind).collect()}  # a row for each centroid


def started(vectors: DataFrame, centroids: int, salt: str, size: int) -> np.ndarray:
    """The vectors whose salted ids have the smallest hashes, as integers."""
    rows = kept(vectors, size).withColumn("hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    first = rows.orderBy(F.col("hash").asc_nulls_last(), "v").limit(centroids).collect()
    return np.array([[whole(x) for x in r.v] for r in first], object).reshape(-1, size)


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector of the trees."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree, _ in opened(batch, size):
                best, distance = nearest(*exact(tree.points, centroids))
                distance = [d if d < 1 << 63 else None for d in map(int, distance)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT, size: int = SIZE) -> DataFrame:
    """A row for every vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    folder = scratch(spark, "kdtree")
    at = started(vectors, centroids, salt, size)
    forest = written(trees(vectors, size), "trees", folder)
    for _ in range(rounds if len(at) else 0):
        after = at.copy()
        for w, (n, sums, _) in totals(forest, at).items():
            after[w] = [s // n for s in sums]
        if (after == at).all():  # nothing will change any more
            break
        at = after
    out = written(assigned(forest, at) if len(at) else spark.createDataFrame([], "vec_id long, cluster int, distance long"), "assigned", folder)
    # a sum that has a null, or doesn't fit a long, is null
    fits = lambda total, n, counted: F.when(n == counted, total.try_cast("long"))
    by = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("counted"))
    by = by.withColumns({"all_total": F.expr("sum(total) over ()"), "all_n": F.expr("sum(n) over ()"), "all_counted": F.expr("sum(counted) over ()")})  # a row for each centroid
    sums = by.select("cluster", fits(F.col("total"), F.col("n"), F.col("counted")).alias("cluster_inertia"), fits(F.col("all_total"), F.col("all_n"), F.col("all_counted")).alias("inertia"))
    names = spark.createDataFrame([(w, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for w, c in enumerate(at)], "cluster int, centroid_sha256 string")
    out = written(out.join(F.broadcast(sums.join(names, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    discard(spark, folder)
    return out
