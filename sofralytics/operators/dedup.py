"""Exact deduplication of scraped records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sofralytics.functions.parsing import review_id_or_hash

VENUE_KEY = ("source", "source_id")
REVIEW_KEY = ("restaurant_source_id", "external_review_id")


def first_per_key(rows: DataFrame, keys, order, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of every key.

    The rank filter is planned as a group limit on the map side: every task sends at most ``keep``
    rows per key to the shuffle, however often one key occurs.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= keep).drop("_rn")


def first_venues(venues: DataFrame, arrival: str = "arrival") -> DataFrame:
    """First seen record of every (source, source_id)."""
    return first_per_key(venues, VENUE_KEY, [arrival])


def with_review_id(reviews: DataFrame) -> DataFrame:
    """Reviews without an external id get the hash of their text, so they are not one shared key."""
    given = F.coalesce(F.col("external_review_id"), F.lit(""))
    return reviews.withColumn("external_review_id", review_id_or_hash(given, F.col("text")))


def first_reviews(reviews: DataFrame, arrival: str = "arrival") -> DataFrame:
    """First seen record of every (venue source id, review id)."""
    return first_per_key(with_review_id(reviews), REVIEW_KEY, [arrival])


def capped_reviews(reviews: DataFrame, cap: int, arrival: str = "arrival") -> DataFrame:
    """At most ``cap`` distinct reviews per venue, in arrival order."""
    return first_per_key(first_reviews(reviews, arrival), ["restaurant_source_id"], [arrival, "external_review_id"], cap)


def unseen(rows: DataFrame, stored: DataFrame, keys) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*keys), list(keys), "left_anti")
