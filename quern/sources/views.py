"""The document store's relations over the given tables: pruned scans, nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.stored import state_of

#: Bytes of a file whose rows one task makes texts of.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, workspace_id, group_id, file_name, processing_status, text."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("workspace_id"), F.col("lang").alias("group_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_name"),
        F.when(F.col("quality") == 0, "INDEXING").otherwise("READY").alias("processing_status"), "text",
    )


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their scan has fewer partitions than there are: a file of one row group is one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Over how many tasks a table of numbers that texts are made of is spread: pieces of PIECE bytes, at least a task a core. What the scan is cut into doesn't tell: row groups can't be parted."""
    size = sum(s for _, s, _ in state_of(spark, f"{sf_dir}/{name}.parquet"))
    return max(spark.sparkContext.defaultParallelism, -(-size // PIECE))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, pos, chunk_text, token_count: a sentence is a chunk."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("document_id"), T.sentences(F.col("text")).alias("s"))
    # outer: an inner one would split every text twice, to find out whether there is a part
    return docs.select("document_id", F.posexplode_outer("s").alias("pos", "chunk_text")).where("chunk_text is not null").withColumn("token_count", T.count_tokens(F.col("chunk_text")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, pos, page_number, line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), T.lines(F.col("text")).alias("l"))
    return docs.select("document_id", F.posexplode_outer("l").alias("pos", "line")).where("line is not null").withColumn("page_number", (F.floor(F.col("pos") / 40) + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, workspace_id, document_id, label, value: the last value that an event gives a document under each label."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    last = e.where("k is not null").groupBy("user_id", "event_type").agg(F.max_by("k", "event_id").alias("value"), F.max("event_id").alias("node_id"))
    return last.select("node_id", (F.col("user_id") % 20).alias("workspace_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("label"), "value")


def vector_text(v: Column) -> Column:
    """A vector of floats as text: eight decimals, in brackets. A half goes to the even digit, by the exact value.

    The formatter rounds the shortest digits of a number, and halves up. A float below ten million times 1e8 is exact as a
    double, so that it can be rounded before; from there on a float has no decimals.
    """
    d = lambda x: x.cast("double")
    exact = lambda x: F.when(F.abs(d(x)) < 1e7, F.rint(d(x) * 1e8) / 1e8).otherwise(d(x))
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.8f", exact(x))), ","), F.lit("]"))


def vector_of(text: str) -> Column:
    """The vector of such a text; none for empty brackets."""
    return F.from_json(F.col(text), "array<double>")
