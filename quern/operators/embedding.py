"""Vectors of texts that have none yet: encoded in bounded batches, kept by the text's hash, merged by appending."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import providers as P
from quern.operators.kg_store import exists
from quern.sources.stored import CODEC

#: Hexadecimal digits of the hash that name a partition.
DIGITS = 1
VECTORS = "text_hash string, embedding array<float>, version int, bucket string"


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """text_hash, embedding, version, bucket of every run that was published."""
    if not exists(spark, f"{root}/published"):
        return spark.createDataFrame([], VECTORS)
    done = spark.read.schema("version int").parquet(f"{root}/published").distinct()
    return spark.read.schema(VECTORS).parquet(f"{root}/vectors").join(F.broadcast(done), "version").select("text_hash", "embedding", "version", "bucket")  # done: a row for each run


def encode_missing(root: str, chunks: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int) -> int:
    """Encodes the texts of chunks(chunk_text) whose hash has no vector, each once, and appends them as a version; blank texts have none. Returns how many were encoded.

    A batch that fails is tried once more. Of a run that fails nothing is read, and the next one encodes all of it.
    """
    spark = chunks.sparkSession
    texts = chunks.where(F.trim("chunk_text") != "").select(text_hash(F.col("chunk_text")).alias("text_hash"), "chunk_text").dropDuplicates(["text_hash"])
    known = vectors(spark, root)
    # by the hash alone, so that the texts stay where they were parted; what is moved into buckets are the vectors
    new = texts.join(known.select("text_hash"), "text_hash", "left_anti")
    version = 1 + (known.agg(F.max("version")).first()[0] or 0)
    made = new.select("text_hash", P.encoder(make, dimension)("chunk_text").alias("embedding")).select("*", F.lit(version).alias("version"), F.concat(F.lit("h"), F.substring("text_hash", 1, DIGITS)).alias("bucket"))
    made.hint("rebalance", "bucket").write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(f"{root}/vectors")
    n = spark.read.schema(VECTORS).parquet(f"{root}/vectors").where(F.col("version") == version).count()
    if n:
        spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{root}/published")
    return n


def with_vectors(chunks: DataFrame, root: str) -> DataFrame:
    """chunks with embedding and the version that encoded it; both null for blank texts and those that aren't encoded yet."""
    v = vectors(chunks.sparkSession, root).select("text_hash", "embedding", "version")
    return chunks.withColumn("text_hash", text_hash(F.col("chunk_text"))).join(v, "text_hash", "left").drop("text_hash")
