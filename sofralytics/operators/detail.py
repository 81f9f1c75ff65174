"""Venue and dish detail: every venue or dish at once, as joins and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.numeric import percent_half_up, round_to
from sofralytics.functions.text import search_key

LABELS = ("positive", "negative", "neutral")


def venue_by_slug(venues: DataFrame, slug: str) -> DataFrame:
    return venues.filter((F.col("slug") == slug) & F.col("is_active")).limit(1)


def venue_platforms(venues: DataFrame, platforms: DataFrame) -> DataFrame:
    """Platform rows of every active venue."""
    active = venues.filter("is_active").select("restaurant_id")
    return platforms.join(active, "restaurant_id", "left_semi")


def venue_scores(scores: DataFrame) -> DataFrame:
    """Dish scores in display order within each venue."""
    order = Window.partitionBy("restaurant_id").orderBy(F.col("score").desc_nulls_first(), "food")
    return scores.select("restaurant_id", "food", "score", "review_count", F.row_number().over(order).cast("long").alias("position"))


def recent_reviews(reviews: DataFrame, platforms: DataFrame, k: int = fv.RECENT_REVIEWS) -> DataFrame:
    """Latest k reviews of every venue, unknown dates first; only k rows per venue and task are shuffled."""
    rows = reviews.drop("restaurant_id", "platform").join(
        platforms.select("restaurant_platform_id", "restaurant_id", "platform"), "restaurant_platform_id"
    )
    order = Window.partitionBy("restaurant_id").orderBy(F.col("review_date").desc_nulls_first(), "review_id")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def label_counts(label: Column) -> list[Column]:
    return [F.count("*").alias("total")] + [F.count_if(label == name).alias(name) for name in LABELS]


def venue_sentiment(mentions: DataFrame, reviews: DataFrame, platforms: DataFrame) -> DataFrame:
    """Label counts per venue over mentions, reviews and platform rows.

    Mentions are reduced to label counts per review first, so the joins move one row per review.
    """
    per_review = mentions.groupBy("review_id").agg(*label_counts(F.col("sentiment")))
    return (
        per_review.join(reviews.select("review_id", "restaurant_platform_id"), "review_id")
        .join(platforms.select("restaurant_platform_id", "restaurant_id"), "restaurant_platform_id")
        .groupBy("restaurant_id")
        .agg(*[F.sum(c).alias(c) for c in ("total", *LABELS)])
    )


def sentiment_summary(counts: DataFrame) -> DataFrame:
    """Integer percentages (neutral takes the rest) and the overall label."""
    total = F.col("total")
    rows = counts.withColumns(
        {"positive_pct": percent_half_up(F.col("positive"), total), "negative_pct": percent_half_up(F.col("negative"), total)}
    )
    rest = F.when(total > 0, F.lit(100) - F.col("positive_pct") - F.col("negative_pct")).otherwise(F.lit(0)).cast("long")
    overall = (
        F.when(F.col("positive_pct") >= 60, "positive")
        .when(F.col("negative_pct") >= 40, "negative")
        .when(total == 0, "neutral")
        .otherwise("mixed")
    )
    return rows.withColumns({"neutral_pct": rest, "overall": overall})


def mentioned_dishes(recent: DataFrame, mentions: DataFrame) -> DataFrame:
    """Dish and label pairs of the recent reviews with how often each occurs; unnamed dishes get a placeholder.

    Counting distinct pairs first bounds each review's list by the dish vocabulary.
    """
    named = mentions.join(recent.select("review_id"), "review_id", "left_semi")
    return named.groupBy("review_id", F.coalesce("food", F.lit(fv.UNKNOWN_DISH)).alias("dish_name"), "sentiment").agg(F.count("*").alias("times"))


def venue_documents(venues: DataFrame, platforms: DataFrame, scores: DataFrame, reviews: DataFrame, mentions: DataFrame) -> DataFrame:
    """One nested row per active venue: platforms, dish scores, recent reviews with dishes, sentiment.

    Array sizes are bounded: platforms per venue by the number of platforms, scores by the dish vocabulary,
    reviews by the recent-review limit.
    """
    active = venues.filter("is_active")
    recent = recent_reviews(reviews, platforms)
    dishes = mentioned_dishes(recent, mentions).groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.struct("dish_name", "sentiment", "times"))).alias("mentioned_dishes")
    )
    review_entry = F.struct("position", "review_id", "rating", "text", "review_date", "platform", "mentioned_dishes")
    review_lists = recent.join(dishes, "review_id", "left").groupBy("restaurant_id").agg(
        F.array_sort(F.collect_list(review_entry), lambda a, b: a["position"] - b["position"]).alias("recent_reviews")
    )
    platform_lists = platforms.groupBy("restaurant_id").agg(
        F.array_sort(F.collect_set(F.struct("platform", "external_id"))).alias("platforms")
    )
    score_lists = venue_scores(scores).groupBy("restaurant_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "food", "score", "review_count"))).alias("food_scores")
    )
    summary = sentiment_summary(venue_sentiment(mentions, reviews, platforms)).select(
        "restaurant_id", F.struct("total", "positive_pct", "negative_pct", "neutral_pct", "overall").alias("sentiment_summary")
    )
    out = active
    for part in (platform_lists, score_lists, review_lists, summary):
        out = out.join(part, "restaurant_id", "left")
    return out


def dish_key(dishes: DataFrame) -> Column:
    """What a dish is looked up by: its canonical name where it has one, else its name, without case and accents."""
    return search_key(F.coalesce("canonical_name", "name") if "canonical_name" in dishes.columns else F.col("name"))


def dish_venues(dishes: DataFrame, scores: DataFrame, venues: DataFrame) -> DataFrame:
    """Active venues serving each dish; names are compared without case and accents."""
    served = scores.select("restaurant_id", "score", "review_count", search_key(F.col("food")).alias("_k"))
    place = venues.filter("is_active").select("restaurant_id", F.col("name").alias("venue"), "slug", "district")
    asked = dishes.select("dish_id", F.col("name").alias("dish"), dish_key(dishes).alias("_k"))
    return served.join(place, "restaurant_id").join(asked, "_k").drop("_k")


def dish_stats(dishes: DataFrame, served: DataFrame) -> DataFrame:
    """Mean, best and worst score, reviews and venues of each dish; NULL and 0 for a dish nobody serves."""
    hundredths = F.round(F.col("score") * 100).cast("long")
    stats = served.groupBy("dish_id").agg(
        round_to(F.sum(hundredths) / F.count("score") / 100.0, 2).alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.sum("review_count").alias("total_reviews"),
        F.countDistinct("restaurant_id").alias("venues"),
    )
    return dishes.select("dish_id", "name").join(stats, "dish_id", "left").withColumns(
        {"total_reviews": F.coalesce("total_reviews", F.lit(0)).cast("long"), "venues": F.coalesce("venues", F.lit(0)).cast("long")}
    )


def dish_sentiment(dishes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Label counts of each dish over all mentions, 0 when it is never mentioned."""
    counts = mentions.groupBy(search_key(F.col("food")).alias("_k")).agg(*label_counts(F.col("sentiment")))
    rows = dishes.select("dish_id", "name", dish_key(dishes).alias("_k")).join(counts, "_k", "left")
    return rows.select("dish_id", "name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", *LABELS)])


def best_venues(served: DataFrame, k: int = 20) -> DataFrame:
    """The k best scored venues of each dish."""
    order = Window.partitionBy("dish_id").orderBy(F.col("score").desc_nulls_first(), "restaurant_id")
    return served.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def dish_by_slug(dishes: DataFrame, slug: str) -> DataFrame:
    """The dish of a slug; none where it is unknown."""
    return dishes.filter(F.col("slug") == slug)


def dish_documents(dishes: DataFrame, scores: DataFrame, venues: DataFrame, mentions: DataFrame, k: int = 20) -> DataFrame:
    """One row a dish: its own columns, ``venues`` (the k best, best first), ``stats`` over all venues and ``sentiment``.

    The k best are found by rank before anything is gathered, so a dish that every venue serves stays a short row.
    """
    served = dish_venues(dishes, scores, venues)
    entry = F.struct("position", "restaurant_id", "venue", "slug", "district", "score", "review_count")
    best = best_venues(served, k).groupBy("dish_id").agg(F.array_sort(F.collect_list(entry)).alias("venues"))
    stats = dish_stats(dishes, served).select(
        "dish_id", F.struct("avg_score", "max_score", "min_score", "total_reviews", F.col("venues").alias("venue_count")).alias("stats")
    )
    felt = dish_sentiment(dishes, mentions).select("dish_id", F.struct("total", *LABELS).alias("sentiment"))
    return dishes.join(best, "dish_id", "left").join(stats, "dish_id").join(felt, "dish_id")
