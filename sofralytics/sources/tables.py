"""Reading reviews to process, stored tables and live databases; writing facts and ledgers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sofralytics import schemas


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table with its declared schema."""
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A live database table read in ``parts`` key ranges; connection details come from the caller."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def backlog(reviews: DataFrame, platforms: DataFrame, batch: int | None = None) -> DataFrame:
    """Unprocessed reviews with text, joined to their venue; the oldest ``batch`` ids when given.

    The limit becomes a per-task top-n before anything is gathered.
    """
    rows = (
        reviews.filter(~F.col("processed") & has_text(F.col("text")))
        .select("review_id", "restaurant_platform_id", "text", "rating")
        .join(platforms.select("restaurant_platform_id", "restaurant_id", "platform"), "restaurant_platform_id")
        .select("review_id", "restaurant_id", "platform", "text", "rating")
    )
    return rows if batch is None else rows.orderBy("review_id").limit(batch)


def labelled_reviews(reviews: DataFrame, limit: int = 1000) -> DataFrame:
    """The first reviews with text by id, as input of weak labelling."""
    return (
        reviews.filter(has_text(F.col("text")))
        .select("review_id", "text", F.col("rating").alias("star_rating"))
        .orderBy("review_id")
        .limit(limit)
    )


def still_open(reviews: DataFrame, done: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows whose id is not in the ledger of processed ids."""
    return reviews.join(done.select(key), key, "left_anti")


def append_mentions(mentions: DataFrame, path: str) -> None:
    """Append mention facts in the declared column order and types."""
    schema = schemas.TABLES["food_mentions"]
    columns = [
        (F.col(f.name) if f.name in mentions.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    mentions.select(*columns).write.mode("append").parquet(path)


def mark_done(ids: DataFrame, path: str) -> None:
    """Append processed ids to the ledger."""
    ids.select("review_id").distinct().write.mode("append").parquet(path)


def run_with_ledger(spark: SparkSession, job: str, output: DataFrame, write, ledger_path: str, reject: Column | None = None) -> dict:
    """Run ``write(output)`` once, counting rows on the way, and append one ledger row.

    Counts come from an observation on the written plan, so no second pass over the data is made.
    A failure is recorded with its message and raised again.
    """
    seen = Observation(job)
    metrics = [F.count(F.lit(1)).alias("rows_written")]
    if reject is not None:
        metrics.append(F.count_if(reject).alias("rows_rejected"))
    observed = output.observe(seen, *metrics)
    started, status, message = datetime.now(), "completed", None
    counts: dict = {}
    try:
        write(observed)
        counts = seen.get
    except Exception as error:
        status, message = "failed", str(error)
        raise
    finally:
        row = (
            job, started, datetime.now(), status, counts.get("rows_written"), counts.get("rows_written"),
            counts.get("rows_rejected", 0), message,
        )
        spark.createDataFrame([row], schemas.JOB_LEDGER).write.mode("append").parquet(ledger_path)
    return counts
