"""Relations that are built once and then read: a table in the shared folder for each session and state of the input."""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.streaming.jobs import base_folder

#: Rows that are broadcast at most.
NAMED = 10_000
#: Of the tables: less than half of what snappy takes for keys and names.
CODEC = "zstd"
_PATHS: dict[tuple, tuple] = {}
_LOCKS: dict[tuple, threading.RLock] = defaultdict(threading.RLock)


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of each file of a folder of tables, none if it isn't there: changed input has another state."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store, found = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    if not store.exists(path):
        return ()
    files = store.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame], *by: str) -> DataFrame:
    """make(spark, sf_dir), written when it is first asked for with these input files, partitioned by columns if any are named. Others that ask meanwhile wait for it."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, sf_dir), name)
    with _LOCKS[key]:
        if key not in _PATHS:
            df, path = make(spark, sf_dir), f"{base_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
            out = df.write.option("compression", CODEC)
            out.partitionBy(*by).parquet(path) if by else out.parquet(path)
            _PATHS[key] = (path, df.schema)  # only a whole table is ever read
    path, schema = _PATHS[key]
    return spark.read.schema(schema).parquet(path)


def few(df: DataFrame, most: int = NAMED) -> DataFrame:
    """df to be broadcast if it has so many rows at most, which is looked up; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: a round of a loop is computed once."""
    path = f"{base_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
