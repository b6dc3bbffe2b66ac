"""Approximate nearest neighbours by multi-index hashing.

Codes: the vectors' directions go through ROTATIONS rotations of the whole space,
each learned to make its sign bits lose little (iterative quantisation), which
gives a code of ROTATIONS * d bits. For the largest inner product the vectors are
first extended by one coordinate that makes all of them equally long.
Index: a code is cut into BITS-bit substrings; for each substring, a table from
its value to the rows that have it.
Search: a code within the Hamming radius r of the query's differs in fewer than
its share of r + 1 bits in some substring (the pigeonhole principle), so probing
each table at all values within that share finds every code within r. What lies
within r is ranked by the inner product of the original vectors in double
precision. Where fewer than k rows lie within r, r grows until k do.

Rotations and r are learned on a bounded sample (SAMPLE distinct vectors, the
first by a hash); r is the CAUGHT quantile of the distances between codes of
sampled nearest neighbours. Every row is indexed. Rows are dealt by a hash over
shards of about SHARD rows, so that copies of one vector never meet in one place;
each is sent and indexed once. Queries are written once to the shared folder,
in batches of BLOCK; a shard's task reads them batch by batch and keeps k rows for
each query. Their lists are then merged.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part. Equal scores go to the smaller
vec_id. A vec_id that is null takes no part; rows with the same vec_id as the
query aren't its neighbours; otherwise equal rows are each a candidate.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import open_in, open_out, scratch, written

K, ROTATIONS, BITS = 20, 4, 8
SAMPLE, ITERATIONS, CAUGHT = 8_192, 25, 0.97
SHARD, BLOCK = 16_384, 2_048
#: Rows of a shard at least, where there are fewer shards than cores.
LEAST = 2_048
WEIGHT = np.array([bin(v).count("1") for v in range(1 << BITS)], np.uint8)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(good)


def directions(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors of one more dimension: x / longest, and what it lacks of length 1."""
    y = x / longest
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]])


def learn(sample: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Rotations by iterative quantisation from random starts."""
    out = []
    for k in range(ROTATIONS):
        r, _ = np.linalg.qr(np.random.default_rng([seed, k]).normal(size=(sample.shape[1],) * 2))
        for _ in range(ITERATIONS):
            u, _, vt = np.linalg.svd(np.where(sample @ r >= 0, 1.0, -1.0).T @ sample)
            r = vt.T @ u.T
        out.append(r)
    return out


def codes(x: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """Substrings of the codes: rows x tables."""
    bits = np.hstack([x @ r >= 0 for r in rotations])
    return np.packbits(bits, axis=1)


def shares(radius: int, tables: int) -> list[int]:
    """The radius of each table: their sum plus the number of tables is radius + 1, so all can't be exceeded at once."""
    total = radius + 1
    return [total // tables + (j < total % tables) - 1 for j in range(tables)]


class Index:
    """The tables of one shard."""

    def __init__(self, substrings: np.ndarray):
        self.rows = substrings
        self.tables = []
        for j in range(substrings.shape[1]):
            order = np.argsort(substrings[:, j], kind="stable")
            values, starts = np.unique(substrings[order, j], return_index=True)
            self.tables.append((values, np.split(order, starts[1:])))

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """queries x rows: which codes lie within the radius."""
        probed = np.zeros((len(queries), len(self.rows)), bool)
        for j, share in enumerate(shares(radius, self.rows.shape[1])):
            if share < 0:
                continue
            values, members = self.tables[j]
            near = WEIGHT[queries[:, j][:, None] ^ values[None, :]] <= share
            for i, rows in enumerate(members):
                probed[np.ix_(np.flatnonzero(near[:, i]), rows)] = True
        out = np.zeros_like(probed)
        for q in range(len(queries)):
            found = np.flatnonzero(probed[q])
            out[q, found[hamming(queries[q : q + 1], self.rows[found])[0] <= radius]] = True
        return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pad = (-a.shape[1]) % 8
    wide = lambda x: np.ascontiguousarray(np.pad(x, ((0, 0), (0, pad)))).view(np.uint64)
    return np.bitwise_count(wide(a)[:, None, :] ^ wide(b)[None, :, :]).sum(2, dtype=np.int32)


def search(index: Index, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, model: tuple, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, the ids of the k best rows found in a shard (ids, x), and their scores."""
    rotations, radius, _ = model
    unit = np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])
    q_codes = codes(unit, rotations)
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        found = index.within(q_codes[part], radius)
        for i, hit in enumerate(found):
            own = ids == q_ids[at + i]
            near = np.flatnonzero(hit & ~own)
            if len(near) < k:  # a wider radius: all codes up to the distance of the k-th
                far = hamming(q_codes[at + i : at + i + 1], index.rows)[0]
                far[own] = 1 << 30
                near = np.flatnonzero((far <= np.partition(far, min(k, len(far)) - 1)[min(k, len(far)) - 1]) & ~own)
            score = np.einsum("ij,j->i", x[near], q[at + i])
            best = np.lexsort((ids[near], -score))[:k]
            yield q_ids[at + i], ids[near[best]], score[best]


def fit(rows: DataFrame) -> tuple:
    """Rotations, radius and the greatest length. The sample is of at most SAMPLE distinct vectors."""
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).first()[0]
    seen = rows.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(SAMPLE).collect()
    longest = float(np.sqrt(longest)) if longest else 1.0
    x = np.array([r.v for r in seen])
    y = directions(x, longest)
    rotations = learn(y)
    c = codes(y, rotations)
    some = slice(0, min(256, len(x)))
    near = x[some] @ x.T
    near[np.arange(len(near)), np.arange(len(near))] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(K, max(1, len(x) - 1))]
    unit = np.hstack([x[some] / np.linalg.norm(x[some], axis=1)[:, None], np.zeros((len(near), 1))])
    far = np.take_along_axis(hamming(codes(unit, rotations), c), top, 1)
    return rotations, int(np.quantile(far, CAUGHT)), longest


def columns(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors."""
    t = pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t
    return t.column("vec_id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), -1)


def query_files(queries: DataFrame, folder: str) -> list[str]:
    """Files in the shared folder that hold the queries, in batches of BLOCK: one for each task at most."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, sink = f"{folder}/queries/{uuid.uuid4().hex}", None, None  # a name for each attempt; the written rows name the files that count
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                if out is None:
                    sink = open_out(path)
                    out = pa.ipc.new_file(sink, batch.schema)
                out.write_batch(batch.slice(at, BLOCK))
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return [r.path for r in written(queries.select("vec_id", "v").mapInArrow(write, "path string"), "queries", folder).collect()]


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row of vectors(vec_id, embedding) that is_query holds for."""
    spark = vectors.sparkSession
    folder = scratch(spark, "ann")
    rows = usable(vectors)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(rows.where(F.size("v") == length.d), "vectors", folder)
    n = rows.count()
    files = query_files(rows.where(is_query), folder)
    model = spark.sparkContext.broadcast((fit(rows), files))
    # small inputs still use all cores
    shards = max(1, -(-n // SHARD), min(spark.sparkContext.defaultParallelism, n // LEAST))
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")

    def shard(_key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, paths = model.value
        ids, x = columns(pa.Table.from_batches(batches))
        index = Index(codes(directions(x, learned[2]), learned[0]))
        for path in paths:
            with open_in(path) as source:
                reader = pa.ipc.open_file(source)
                for at in range(reader.num_record_batches):
                    found = list(search(index, ids, x, *columns(reader.get_batch(at)), learned, k))
                    sizes = [len(i) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, *_ in found], sizes), pa.int64()), pa.array(np.concatenate([i for _, i, _ in found]), pa.int64()), pa.array(np.concatenate([s for *_, s in found]), pa.float64())], ["query_id", "vec_id", "score"])

    found = rows.select(spread.alias("shard"), "vec_id", "v").groupBy("shard").applyInArrow(shard, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
