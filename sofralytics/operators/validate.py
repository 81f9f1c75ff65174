"""Bronze to silver: reject reasons, cleaning, quarantine split and quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sofralytics.functions import parsing
from sofralytics.functions.text import strip

VENUE_REQUIRED = ("name", "source", "source_id")
REVIEW_REQUIRED = ("restaurant_source", "restaurant_source_id", "text")
MIN_REVIEW_CHARS = 3


def blank(value: Column) -> Column:
    return value.isNull() | (strip(value.cast("string")) == "")


def _first_missing(columns) -> Column:
    reason = None
    for name in columns:
        hit = blank(F.col(name))
        label = F.lit(f"missing {name}")
        reason = F.when(hit, label) if reason is None else reason.when(hit, label)
    return reason


def venue_reject_reason() -> Column:
    """Name of the first missing required venue field, NULL for a valid row."""
    return _first_missing(VENUE_REQUIRED)


def review_reject_reason() -> Column:
    """Missing required review field, or text shorter than three characters; NULL for a valid row."""
    short = F.length(strip(F.col("text"))) < MIN_REVIEW_CHARS
    return _first_missing(REVIEW_REQUIRED).when(short, F.lit("text too short"))


def flag_venues(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn("reject_reason", venue_reject_reason())


def flag_reviews(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn("reject_reason", review_reject_reason())


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reason)."""
    return (
        flagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        flagged.filter(F.col("reject_reason").isNotNull()),
    )


def reject_counts(flagged: DataFrame) -> DataFrame:
    """Accepted and rejected rows by reason."""
    return flagged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def clean_venues(valid: DataFrame, run_ts: Column) -> DataFrame:
    """Trimmed name and address, phone digits, scrape time filled in from the run."""
    return valid.withColumns(
        {
            "name": strip(F.col("name")),
            "address": strip(F.col("address")),
            "phone": parsing.clean_phone(F.col("phone")),
            "scraped_at": parsing.scraped_timestamp(F.col("scraped_at"), run_ts),
        }
    )


def clean_reviews(valid: DataFrame, run_ts: Column) -> DataFrame:
    """Trimmed text, language default, whole stars 1-5, parsed dates."""
    return valid.withColumns(
        {
            "text": strip(F.col("text")),
            "language": F.when(blank(F.col("language")), F.lit("tr")).otherwise(F.col("language")),
            "rating": parsing.clean_rating(F.col("rating")),
            "review_date": parsing.parse_timestamp(F.col("review_date")),
            "scraped_at": parsing.scraped_timestamp(F.col("scraped_at"), run_ts),
        }
    )


def bounds_report(df: DataFrame, rules: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """Per rule: rows checked, rows outside the bounds, NULL rows; one pass over the table."""
    aggs = []
    for name, (value, low, high) in rules.items():
        aggs += [
            F.count_if(value.isNotNull() & ~value.between(low, high)).alias(f"{name}_outside"),
            F.count_if(value.isNull()).alias(f"{name}_missing"),
        ]
    return df.agg(F.count("*").alias("rows_checked"), *aggs)


def score_band(score: Column) -> Column:
    """``high`` from 8, ``mid`` from 5, else ``low``; NULL scores have no band."""
    return F.when(score >= 8, "high").when(score >= 5, "mid").when(score.isNotNull(), "low")


def clean_feed(bronze_venues: DataFrame, bronze_reviews: DataFrame, run_ts: Column) -> dict[str, DataFrame]:
    """Silver venues and reviews plus the quarantined rows of both."""
    venues, bad_venues = split(flag_venues(bronze_venues))
    reviews, bad_reviews = split(flag_reviews(bronze_reviews))
    return {
        "venues": clean_venues(venues, run_ts),
        "reviews": clean_reviews(reviews, run_ts),
        "rejected_venues": bad_venues,
        "rejected_reviews": bad_reviews,
    }
