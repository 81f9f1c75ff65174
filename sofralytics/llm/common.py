"""Helpers shared by the operators: input tables, tables written between steps, Arrow batch sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a regular expression class.
BLANKS = "[\\x20\\x09-\\x0D]+"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``; set here only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Write a step's rows as Parquet to the shared folder and return a scan of them.

    This cuts the lineage: a lost executor costs a re-read, not the steps before.  The step's shuffle files are of no
    more use once its rows are written, so Spark is told to drop them then.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker holds few whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@contextmanager
def setting(spark: SparkSession, key: str, value) -> Iterator[None]:
    """A session setting that holds while the jobs in this block run."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A function that writes rows as a table of the shared warehouse; its tables are dropped at the end of the block.

    With a column the table is bucketed by it, so that later groups of that column are read without a shuffle.
    """
    names: list[str] = []

    def keep(frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
        names.append(f"scratch_{name}_{uuid.uuid4().hex}")
        writer = frame.write.format("parquet")
        if by:
            writer = writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by)
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            writer.saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        yield keep
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def working(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes a step's rows to the shared folder; what it wrote is deleted at the end of the block.

    The rows are tables of a database of their own in that folder, so dropping it deletes its files wherever they are.
    """
    base = f"working_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {base} LOCATION '{shared_folder(spark)}/{base}'")

    def keep(frame: DataFrame, name: str) -> DataFrame:
        table = f"{base}.{name}_{uuid.uuid4().hex}"
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            frame.write.format("parquet").saveAsTable(table)
        return spark.table(table)

    try:
        yield keep
    finally:
        spark.sql(f"DROP DATABASE {base} CASCADE")


def arrow_rows(spark: SparkSession, rows: int):
    """Bound the rows of an Arrow batch."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def mapped(frame: DataFrame, run, schema: str, name: str, rows: int = 256, keep: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """``mapInArrow`` over few rows at a time, written by ``keep``: for good, or as long as a block ``working`` lasts."""
    with arrow_rows(frame.sparkSession, rows):
        return keep(frame.mapInArrow(run, schema), name)


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text (bytes.split splits on exactly the six blanks), a bounded stretch of the text at a time."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + size)
        end = blank.start() if blank else len(text)
        if found := text[at:end].split():
            yield found
        at = end


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have (names differ regardless of case)."""
    held = {c.lower() for c in frame.columns}
    while name.lower() in held:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus).cast("bigint"))
