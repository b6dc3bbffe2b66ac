"""Files in and out: uploads by rule, originals by path, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS, MOST_BYTES = ("pdf", "docx"), 20 << 20


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.([^.]+)$", 1))


def reject_code(size: Column, most: int = MOST_BYTES) -> Column:
    return F.when(size == 0, "EMPTY").when(size > most, "TOO_LARGE")


def verdict(path: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """Why a file is refused: EMPTY, TOO_LARGE, EXTENSION; null for one that is accepted."""
    return F.coalesce(reject_code(size, most), F.when(~extension_of(path).isin(*EXTENSIONS), "EXTENSION"))


def module_of(path: Column) -> Column:
    """The top-level folder of a relative path, which names a module; null where there is none or it is . or .."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", ""), "/")
    return F.when((F.size(parts) >= 2) & ~parts[0].isin("", ".", ".."), parts[0])


def storage_path(workspace: Column, document: Column, extension: Column) -> Column:
    return F.concat(F.lit("workspace/"), workspace, F.lit("/document/"), document.cast("string"), F.lit("/original."), extension)


# Media types by extension.
MEDIA = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def media_type(stored: Column, extension: Column) -> Column:
    by_name = F.lit("application/octet-stream")
    for name, kind in MEDIA.items():
        by_name = F.when(extension == name, kind).otherwise(by_name)
    return F.coalesce(F.nullif(stored, F.lit("")), by_name)


def uploads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files of a folder: path, length, extension, reject_code. Contents aren't read; empty files are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    judged = found.withColumn("extension", extension_of(F.col("path"))).withColumn("reject_code", verdict(F.col("path"), F.col("length")))
    return judged.where("reject_code is null"), judged.where("reject_code is not null")


def csv_field(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\n]'), quoted).otherwise(value)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, quote='"', escape='"')


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
