"""What the operators of this subpackage share: the shared folder, written cuts of lineage, lower-casing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir, or a new local one where it is unset and there is one machine."""
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


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder (in a folder of it), read again: cuts the lineage, survives lost executors, and is computed once."""
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}" if folder else scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables and files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Spark's lower() does the same, faster, unless a character beyond ASCII has a lower case."""
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(rest) == rest, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_STATE: dict = {}


def worker_state(key, make):
    """What the tasks of one operator share within a Python worker (a model, a memo). A worker keeps one at a time."""
    if key not in _STATE:
        _STATE.clear()
        gc.collect()
        _STATE[key] = make()
    return _STATE[key]


def uri(path: str) -> str:
    """Hadoop writes file:/x, Arrow reads file:///x."""
    return re.sub(r"^file:/+", "file:///", path)


def open_out(path: str):
    """An output stream on any store that Arrow knows."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri(path))
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)


def open_in(path: str):
    """A random-access input: a memory map where the store is a mounted file system."""
    import pyarrow as pa
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri(path))
    return pa.memory_map(inner, "r") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner)
