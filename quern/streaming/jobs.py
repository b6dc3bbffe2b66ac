"""Incremental ingestion: job events as a file stream, folded into a status table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster, as spark.checkpoint.dir or the context has it; one local folder for the session where neither is set and there is one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir isn't set: the executors of {sc.master} need a folder that they share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="quern-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def status(events: DataFrame) -> DataFrame:
    """document_id, stage, n, last_event; additive, so batches can be folded."""
    return events.groupBy(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads all event files that are there as a stream. Each batch writes its partial counts under its number, so that a batch that is run again replaces itself."""
    folder = f"{base_folder(spark)}/jobs-{uuid.uuid4().hex[:12]}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")

    def fold(batch: DataFrame, number: int) -> None:
        status(batch).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/parts").groupBy("document_id", "stage").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window of event time and stage; events later than the watermark are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
