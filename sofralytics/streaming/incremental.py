"""Structured Streaming forms of ingest, extraction and scoring.

Progress lives in the checkpoint folder: a restarted query continues after the last committed batch.  Batch
numbers version the written tables, so a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sofralytics.operators import dedup, scoring, upsert
from sofralytics.sources import versions


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; the schema is declared, never inferred."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived since the last run, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def first_seen(stream: DataFrame, keys, event_time: str, horizon: str = "7 days") -> DataFrame:
    """First record of every key within the horizon.

    State is bounded by the watermark: a repeat that arrives more than ``horizon`` later passes again and is
    then absorbed by the upsert.  Records older than the watermark are dropped, first ones too; use
    ``first_seen_batches`` for sources that deliver such records.
    """
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(keys))


def first_seen_batches(keys, root: str) -> Callable[[DataFrame, int], None]:
    """Keep the first record of every key, however late it comes: a batch less the keys that earlier batches kept.

    For sources that backfill, where ``first_seen`` would drop what is older than its watermark.  A retried batch is
    compared with the batches before it only, so it gives the same rows again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(list(keys))
        stored = versions.earlier(batch.sparkSession, root, number)
        if stored is not None:
            fresh = fresh.join(stored.select(*keys), list(keys), "left_anti")
        versions.write(fresh.select(*batch.columns), root, number)

    return handle


def append_batches(transform: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Write ``transform(batch)`` under the batch number."""

    def handle(batch: DataFrame, number: int) -> None:
        versions.write(transform(batch), out, number)

    return handle


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All batches written by ``append_batches``."""
    return spark.read.parquet(out).drop("v")


def upsert_batches(root: str, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame) -> Callable[[DataFrame, int], None]:
    """Apply each micro-batch to the newest version of a table."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = versions.latest(spark, root, before=number)
        versions.write(merge(empty if stored is None else stored, batch), root, number)

    return handle


def review_upserts(root: str, platforms: DataFrame, empty: DataFrame, orphan_root: str) -> Callable[[DataFrame, int], None]:
    """Reviews linked to their platform row and upserted; reviews of unknown venues are kept aside."""

    def handle(batch: DataFrame, number: int) -> None:
        linked, orphans = upsert.link_reviews(dedup.with_review_id(batch), platforms)
        versions.write(orphans, orphan_root, number)
        stored = versions.latest(batch.sparkSession, root, before=number)
        versions.write(upsert.upsert_reviews(empty if stored is None else stored, linked), root, number)

    return handle


def score_batches(root: str) -> Callable[[DataFrame, int], None]:
    """Running sums per (venue, dish): each batch adds to the stored sums, so scores always cover all mentions."""

    def handle(batch: DataFrame, number: int) -> None:
        fresh = scoring.dish_sums(batch)
        stored = versions.latest(batch.sparkSession, root, before=number)
        versions.write(fresh if stored is None else scoring.merge_sums(stored, fresh), root, number)

    return handle


def running_scores(spark: SparkSession, root: str) -> DataFrame:
    """Scores from the newest sums."""
    return scoring.finish_scores(versions.latest(spark, root))
