"""The review job as a stream: each micro-batch is extracted, labelled and scored, and lands in all tables or in none.

One commit (``sources.buckets``) holds the batch's mentions, the sums its dish scores come from, the ids it is done with
and the rows it could not use.  A batch that is run again, after a stop at any point or with a lost checkpoint, leaves out
the ids that are done, so every review counts once; scores are those of one batch run over all reviews.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sofralytics.operators import scoring, sentiment
from sofralytics.plans import jobs
from sofralytics.sources.buckets import Store
from sofralytics.sources.tables import has_text
from sofralytics.streaming.incremental import drain

MENTIONS, SUMS, DONE, QUARANTINE = "mentions", "sums", "done", "quarantine"


def reject_reason(rows: DataFrame) -> Column:
    """Why a review cannot be used, null where it can."""
    return (
        F.when(F.col("review_id").isNull(), "no id").when(F.col("restaurant_id").isNull(), "no venue").when(~has_text(F.col("text")), "no text")
    )


def review_batches(root: str, entries: DataFrame, vectors: DataFrame, seeds: DataFrame, fuzzy: bool = False, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Handle micro-batches of reviews (review_id, restaurant_id, text, star_rating).

    Of rows with one id in a batch the first by text counts; rows without an id are set aside each time they come.
    """

    def handle(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, root, buckets)
        done = store.appended(DONE, batch.select("review_id").schema)
        shape = ["review_id", "restaurant_id", "text", "star_rating"]
        first = batch.groupBy("review_id").agg(F.min(F.struct("text", "restaurant_id", "star_rating")).alias("r")).filter("review_id IS NOT NULL")
        named = first.select("review_id", "r.restaurant_id", "r.text", "r.star_rating").join(done, "review_id", "left_anti")
        rows = named.unionByName(batch.filter("review_id IS NULL").select(*shape))
        if rows.isEmpty():
            return
        work = store.commit()
        rows = work.stage(rows.withColumn("reason", reject_reason(rows)), "rows")
        good = rows.filter("reason IS NULL").drop("reason")
        mentions = work.stage(jobs.process_reviews(good, entries, vectors, seeds, fuzzy)["mentions"], MENTIONS)
        work.append(MENTIONS, mentions)
        sums = work.stage(scoring.dish_sums(sentiment.scoring_rows(mentions, good)), SUMS)
        work.merge(SUMS, sums, ["restaurant_id"], scoring.merge_sums)
        work.append(QUARANTINE, rows.filter("reason IS NOT NULL"))
        work.append(DONE, rows.select("review_id").filter("review_id IS NOT NULL"))
        work.finish()

    return handle


def run_stream(stream: DataFrame, root: str, checkpoint: str, entries: DataFrame, vectors: DataFrame, seeds: DataFrame, fuzzy: bool = False, buckets: int = 64):
    """Process what has arrived since the last run, then stop."""
    return drain(stream, review_batches(root, entries, vectors, seeds, fuzzy, buckets), checkpoint)


def scores(spark: SparkSession, root: str, venue_type: str = "bigint", buckets: int = 64) -> DataFrame:
    """Dish scores over all committed reviews."""
    shape = ", ".join([f"restaurant_id {venue_type}", "food string", *[f"{c} bigint" for c in scoring.SUM_COLUMNS]])
    return scoring.finish_scores(Store(spark, root, buckets).read(SUMS, spark.createDataFrame([], shape).schema))


def bucketed_upserts(root: str, table: str, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Apply each micro-batch to a bucketed table; only touched buckets are written.

    The batch's number is the commit's: a batch at or below the newest commit is in the table already and is left out,
    also where the checkpoint is lost and the stream begins again with the same files.
    """

    def handle(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, root, buckets)
        if number <= store.committed():
            return
        work = store.commit(number)
        work.merge(table, work.stage(batch, table), keys, merge, empty.schema)
        work.finish()

    return handle


def bucketed_sums(root: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Running sums per (venue, dish) in a bucketed table; each batch is added once."""

    def handle(batch: DataFrame, number: int) -> None:
        fresh = scoring.dish_sums(batch)
        bucketed_upserts(root, SUMS, ["restaurant_id"], scoring.merge_sums, fresh, buckets)(fresh, number)

    return handle
