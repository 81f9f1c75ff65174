"""Upserts as one aggregation and one join; the caller writes the result to a new location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_state(changes: DataFrame, keys, replace=(), keep=(), arrival: str = "arrival") -> DataFrame:
    """Changes of one key folded in arrival order.

    ``replace`` columns take the last row's value, ``keep`` columns the last value that is not NULL.
    ``max_by`` combines on the map side, so a key with very many changes stays cheap.
    """
    when = F.col(arrival)
    folded = [F.max_by(c, when).alias(c) for c in replace]
    folded += [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in keep]
    return changes.groupBy(*keys).agg(*folded)


def upsert(target: DataFrame, changes: DataFrame, keys, replace=(), keep=(), untouched=None, arrival: str = "arrival") -> DataFrame:
    """Target with the changes applied.

    Matched rows: ``replace`` columns are overwritten, ``keep`` columns only by non-NULL values.
    New rows take the changed values; ``untouched`` maps further target columns to their default.
    """
    untouched = untouched or {}
    fresh = last_state(changes, keys, replace, keep, arrival).withColumn("_new", F.lit(True))
    old, new = target.alias("o"), fresh.alias("n")
    condition = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = old.join(new, condition, "full_outer")
    changed = F.col("n._new").isNotNull()
    out = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    out += [F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in replace]
    out += [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in keep]
    matched = F.col(f"o.{keys[0]}").isNotNull()
    out += [F.when(matched, F.col(f"o.{c}")).otherwise(default).alias(c) for c, default in untouched.items()]
    return joined.select(*out)


VENUE_KEEP = ("address", "district", "neighborhood", "location", "phone", "website", "cuisine_type",
              "price_range", "overall_score", "total_reviews", "image_url")
PLATFORM_KEEP = ("external_url", "platform_score", "platform_reviews", "raw_data")
REVIEW_KEEP = ("author_name", "rating", "review_date", "language")


def _present(frame: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in frame.columns]


def upsert_venues(target: DataFrame, changes: DataFrame) -> DataFrame:
    """By slug: the name is always replaced, other columns only by known values."""
    return upsert(target, changes, ["slug"], replace=_present(changes, ["name", "updated_at"]), keep=_present(changes, VENUE_KEEP))


def upsert_platforms(target: DataFrame, changes: DataFrame) -> DataFrame:
    """By (platform, external_id): the venue link is replaced, other columns only by known values."""
    return upsert(
        target, changes, ["platform", "external_id"],
        replace=_present(changes, ["restaurant_id", "last_scraped"]), keep=_present(changes, PLATFORM_KEEP),
    )


def link_reviews(reviews: DataFrame, platforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews with their platform row id, reviews whose venue is not known yet)."""
    keys = [reviews["restaurant_source"] == platforms["platform"], reviews["restaurant_source_id"] == platforms["external_id"]]
    linked = reviews.join(platforms.select("platform", "external_id", "restaurant_platform_id"), keys, "inner")
    orphans = reviews.join(platforms, keys, "left_anti")
    return linked.drop("platform", "external_id"), orphans


def upsert_reviews(target: DataFrame, linked: DataFrame) -> DataFrame:
    """By (platform row, review id): text and scrape time replaced, processed flag left alone."""
    return upsert(
        target, linked, ["restaurant_platform_id", "external_review_id"],
        replace=_present(linked, ["text", "scraped_at"]), keep=_present(linked, REVIEW_KEEP),
        untouched={"processed": F.lit(False)},
    )


def upsert_scores(target: DataFrame, fresh: DataFrame) -> DataFrame:
    """Freshly computed (venue, dish) rows replace the stored ones.

    Both sides hold one row per key, so the result is the fresh rows plus the stored keys that were
    not recomputed: one anti join instead of a full outer join.
    """
    keys = ["restaurant_id", "food"]
    return target.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def recount_reviews(venues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Venues with their number of reviews, 0 when there are none."""
    counts = reviews.groupBy("restaurant_id").agg(F.count("*").alias("_n"))
    return (
        venues.drop("total_reviews")
        .join(counts, "restaurant_id", "left")
        .withColumn("total_reviews", F.coalesce("_n", F.lit(0)).cast("long"))
        .drop("_n")
    )
