"""A table kept as numbered versions, so a rewrite never touches the files being read.

Each version is a complete Parquet folder ``v=<n>``; a version counts once its ``_SUCCESS`` marker exists.
Writing version n again (a retried micro-batch) replaces it and gives the same content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, root: str) -> bool:
    path, fs = _file_system(spark, root)
    return fs.exists(path)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders, those that are there."""
    for folder in folders:
        path, fs = _file_system(spark, folder)
        fs.delete(path, True)


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The complete versions, oldest first."""
    path, fs = _file_system(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def latest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (older than ``before`` when given), or None."""
    known = [v for v in numbers(spark, root) if before is None or v < before]
    return spark.read.parquet(f"{root}/v={known[-1]}") if known else None


def earlier(spark: SparkSession, root: str, before: int) -> DataFrame | None:
    """The rows of all complete versions older than ``before``, for tables whose versions are increments; or None."""
    known = [v for v in numbers(spark, root) if v < before]
    return spark.read.parquet(*[f"{root}/v={v}" for v in known]) if known else None


def write(frame: DataFrame, root: str, version: int) -> None:
    frame.write.mode("overwrite").parquet(f"{root}/v={version}")
