"""Sharding by a two-pass external shuffle.

Pass one scatters the records over buckets with a seeded hash. The number of
buckets follows the bytes of the input, so that a bucket fits a task's memory
(24 MB; more where that would make over a million buckets). Pass two shuffles each
bucket by Fisher-Yates and writes it; a task takes a run of buckets. The buckets one
after another are one random order of all records, and the shards are equal runs of
it: law `rows`, counts at most one apart.

The hash is of the seed, the doc_id and the text, so a seed gives the same shards
however the input is cut into files. Rows equal in both are numbered, and the
number goes into the hash, so that any many of them spread like others. Defined
results: a null text has size 1 and the checksum of the empty text; an empty table
gives no rows; with fewer rows than shards, the last shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import scratch, written

SHARDS, SEED = 16, 20_240_607
#: Bytes of text and rows in a bucket, on average.
BUCKET_BYTES, BUCKET_ROWS = 24 << 20, 200_000
#: Buckets at most, so that a row for each (12 MB at most) can go to all tasks; and tasks of the second pass at most.
MOST_BUCKETS, MOST_TASKS = 1 << 20, 1 << 14


def numbered(rows: DataFrame, seed: int) -> DataFrame:
    """rows(doc_id, text) with mark, a hash. Of rows that are equal in doc_id and text each has one of its own: they are counted task by task, so no task gets them all."""
    key = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    marked = rows.withColumn("mark", key)
    often = written(rows.select(key.alias("mark")).groupBy("mark").count().where("count > 1").select("mark", F.lit(True).alias("often")), "often")
    if not often.limit(1).count():
        return marked
    parts = marked.withColumn("part", F.spark_partition_id()).join(often, "mark", "left")
    sizes = parts.where("often").groupBy("mark", "part").count()
    before = sizes.select("mark", "part", (F.sum("count").over(Window.partitionBy("mark").orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("mark", "part").orderBy("mark")) + F.col("before")
    again = parts.where("often").join(before, ["mark", "part"]).withColumn("mark", F.xxhash64("mark", place))
    return parts.where("often is null").select("doc_id", "text", "mark").unionByName(again.select("doc_id", "text", "mark"))


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1."""
    out = list(range(n))
    # j is uniform over 0..i for each i from the end
    for i, j in zip(range(n - 1, 0, -1), (rng.random(n - 1) * np.arange(n, 1, -1)).astype(np.int64).tolist() if n > 1 else [], strict=True):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes docs(doc_id, text) in shards and returns the written table: doc_id, text, shard, slot."""
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = min(MOST_BUCKETS, max(1, -(-(size or 0) // bucket_bytes), -(-n // BUCKET_ROWS)))
    tasks = min(buckets, MOST_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # should a task read several buckets, each is shuffled and passed on by itself
        held, at = [], None

        def out(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            order = fisher_yates(len(t), np.random.default_rng([seed, bucket]))
            t = t.take(pa.array(order)).append_column("place", pa.array(np.arange(len(t))))
            yield from t.to_batches(max_chunksize=5_000)

        for batch in batches:
            keys = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and keys[i] != at:
                    yield from out(at, held)
                    held = []
                at = int(keys[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from out(at, held)

    scattered = numbered(rows, seed).withColumn("bucket", F.pmod("mark", F.lit(buckets)).cast("int"))
    dealt = scattered.repartitionById(tasks, (F.col("bucket") % tasks).cast("int")).sortWithinPartitions("bucket", "mark", "doc_id")
    placed = written(dealt.mapInArrow(run, "doc_id long, text string, mark long, bucket int, place long"), "shuffled")
    # how many records come before each bucket: a row for each bucket, MOST_BUCKETS at most
    counts = placed.groupBy("bucket").count()
    offsets = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    small, larger = divmod(n, shards)
    whole = F.col("before") + F.col("place")
    bound = F.lit(larger * (small + 1))
    long_run, short_run = F.lit(small + 1), F.lit(max(small, 1))
    shard = F.when(whole < bound, F.floor(whole / long_run)).otherwise(larger + F.floor((whole - bound) / short_run))
    slot = F.when(whole < bound, whole % long_run).otherwise((whole - bound) % short_run)
    return placed.join(F.broadcast(offsets), "bucket").select("doc_id", "text", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str | None = None, **options) -> str:
    """The shards as files: path/shard=<n>/. A task holds a run of few shards, so files stay as many as buckets."""
    path = path or scratch(docs.sparkSession, "shards")
    shuffle(docs, **options).write.partitionBy("shard").parquet(path)
    return path


def digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of the written records."""
    return shuffle(docs, shards).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
