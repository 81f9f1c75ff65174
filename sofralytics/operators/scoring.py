"""Dish scores, ranking and reports.

Scores are built from sums that merge: confidence and stars enter as scaled integers, so adding
partial sums in any order (map-side combine, micro-batches, reruns) gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.text import strip
from sofralytics.functions.numeric import round_to

SUM_COLUMNS = (
    "positive_count", "neutral_count", "negative_count", "usable_count",
    "weight_sum", "weighted_sentiment_sum", "star_weight_sum", "weighted_star_sum",
)
CONFIDENCE_SCALE = 10_000
STAR_SCALE = 100


def sentiment_value(label: Column) -> Column:
    """+1 / 0 / -1; NULL for an unknown label."""
    name = F.lower(label)
    return F.when(name == "positive", 1).when(name == "neutral", 0).when(name == "negative", -1)


def star_value(stars: Column) -> Column:
    """Stars limited to 1-5 and mapped onto -1..+1."""
    limited = F.greatest(F.lit(1.0), F.least(F.lit(5.0), stars.cast("double")))
    return F.when(stars.isNotNull(), (limited - 3.0) / 2.0)


def scale_to_ten(value: Column) -> Column:
    """-1..+1 onto 1..10."""
    limited = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    return (limited + 1.0) / 2.0 * 9.0 + 1.0


def weighted_mean(weighted_sum: Column, weight_sum: Column) -> Column:
    """Weighted mean from its two sums; 0 when the weights add up to 0."""
    return F.coalesce(weighted_sum / F.when(weight_sum != 0, weight_sum), F.lit(0.0))


def dish_sums(mentions: DataFrame, keys=("restaurant_id", "food")) -> DataFrame:
    """Mergeable sums per venue and dish.

    ``mentions``: keys, sentiment, confidence, star_rating.  Blank dish names are dropped, names are
    trimmed and lower-cased.  One hash aggregation; the map side combines, so a venue that holds a
    third of all mentions still ships one row per task and dish.
    """
    value = sentiment_value(F.col("sentiment"))
    weight = F.round(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) * CONFIDENCE_SCALE).cast("long")
    rows = (
        mentions.withColumn("food", F.lower(strip(F.col("food"))))
        .filter(F.col("food") != "")
        .select(
            *keys,
            value.cast("long").alias("_v"),
            F.when(value.isNotNull() & (weight >= int(fv.MIN_CONFIDENCE * CONFIDENCE_SCALE)), weight).alias("_w"),
            F.round(star_value(F.col("star_rating")) * STAR_SCALE).cast("long").alias("_s"),
        )
    )
    v, w, s = F.col("_v"), F.col("_w"), F.col("_s")
    zero = F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(c), zero)
    return rows.groupBy(*keys).agg(
        F.count_if(v == 1).alias("positive_count"),
        F.count_if(v == 0).alias("neutral_count"),
        F.count_if(v == -1).alias("negative_count"),
        F.count(w).alias("usable_count"),
        total(w).alias("weight_sum"),
        total(w * v).alias("weighted_sentiment_sum"),
        total(F.when(s.isNotNull(), w)).alias("star_weight_sum"),
        total(w * s).alias("weighted_star_sum"),
    )


def merge_sums(stored: DataFrame, fresh: DataFrame, keys=("restaurant_id", "food")) -> DataFrame:
    """Stored sums plus the sums of a new batch."""
    return stored.unionByName(fresh).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUM_COLUMNS])


def _score() -> Column:
    sentiment = weighted_mean(F.col("weighted_sentiment_sum"), F.col("weight_sum"))
    stars = weighted_mean(F.col("weighted_star_sum") / float(STAR_SCALE), F.col("star_weight_sum"))
    return round_to(scale_to_ten(sentiment * fv.SENTIMENT_WEIGHT + stars * fv.STAR_WEIGHT), 2)


def finish_scores(sums: DataFrame, keys=("restaurant_id", "food"), min_reviews: int = fv.MIN_REVIEWS) -> DataFrame:
    """Score, confidence and distribution from the sums."""
    count = F.col("positive_count") + F.col("neutral_count") + F.col("negative_count")
    confidence = weighted_mean(F.col("weight_sum") / float(CONFIDENCE_SCALE), F.col("usable_count"))
    confidence = F.when(count < min_reviews, confidence * count / float(min_reviews)).otherwise(confidence)
    return sums.select(
        *keys,
        _score().alias("score"),
        round_to(confidence, 4).alias("confidence"),
        F.col("positive_count"),
        F.col("neutral_count"),
        F.col("negative_count"),
        count.alias("review_count"),
        (count >= min_reviews).alias("enough_data"),
    )


def score_dishes(mentions: DataFrame, keys=("restaurant_id", "food")) -> DataFrame:
    """Dish scores per venue over all mentions."""
    return finish_scores(dish_sums(mentions, keys), keys)


def rank_dishes(scores: DataFrame, min_reviews: int = fv.MIN_REVIEWS) -> DataFrame:
    """Rank within each venue: dishes with enough data by score, then the rest by review count.

    The window runs over scored (venue, dish) rows, so a partition holds at most the dish vocabulary.
    """
    enough = F.col("review_count") >= min_reviews
    order = Window.partitionBy("restaurant_id").orderBy(
        enough.desc(),
        F.when(enough, F.col("score")).otherwise(F.col("review_count").cast("double")).desc(),
        F.col("food"),
    )
    return scores.select(
        "restaurant_id",
        F.row_number().over(order).cast("long").alias("rank"),
        "food",
        "score",
        "confidence",
        "review_count",
        enough.alias("enough_data"),
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Per venue: dishes, reviews, dishes with and without enough data, mean score of reviewed dishes."""
    enough = F.col("review_count") >= fv.MIN_REVIEWS
    hundredths = F.round(F.col("score") * 100).cast("long")
    reviewed = F.col("review_count") > 0
    return scores.groupBy("restaurant_id").agg(
        F.count("*").alias("dish_count"),
        F.sum("review_count").alias("total_reviews"),
        F.count_if(enough).alias("enough_count"),
        F.count_if(~enough).alias("thin_count"),
        round_to(F.sum(F.when(reviewed, hundredths)) / F.count_if(reviewed) / 100.0, 1).alias("mean_score"),
    )


def best_and_worst(scores: DataFrame, k: int = 5) -> DataFrame:
    """Best k and worst k dishes of each venue among those with enough data.

    Two top-k windows, each with a map-side group limit.  The worst list is the ranking read from its
    end and is left out for a venue with a single ranked dish.
    """
    ranked = scores.filter(F.col("review_count") >= fv.MIN_REVIEWS)
    best = Window.partitionBy("restaurant_id").orderBy(F.col("score").desc(), F.col("food"))
    worst = Window.partitionBy("restaurant_id").orderBy(F.col("score"), F.col("food").desc())
    cols = ["restaurant_id", "food", "score", "review_count"]
    top = ranked.select(*cols, F.row_number().over(best).alias("position")).filter(F.col("position") <= k)
    low = ranked.select(*cols, F.row_number().over(worst).alias("position")).filter(F.col("position") <= k)
    several = ranked.groupBy("restaurant_id").count().filter("count > 1").select("restaurant_id")
    return top.withColumn("list", F.lit("best")).unionByName(
        low.join(several, "restaurant_id", "left_semi").withColumn("list", F.lit("worst"))
    )


def thin_data(scores: DataFrame) -> DataFrame:
    """Dishes whose review count is below the minimum."""
    return scores.filter(F.col("review_count") < fv.MIN_REVIEWS).select(
        "restaurant_id", "food", "score", "review_count"
    )


def venue_dish_mart(mentions: DataFrame) -> DataFrame:
    """Per venue and dish: mean sentiment, label counts, mentions and score."""
    total = F.col("positive_count") + F.col("neutral_count") + F.col("negative_count")
    return dish_sums(mentions).select(
        "restaurant_id",
        "food",
        round_to((F.col("positive_count") - F.col("negative_count")) / F.when(total > 0, total), 2).alias("avg_sentiment"),
        "positive_count",
        "negative_count",
        "neutral_count",
        total.alias("total_mentions"),
        _score().alias("computed_score"),
    )


def batch_totals(reviews: DataFrame, processed: DataFrame, failed: DataFrame, mentions: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of totals of a run: fetched, processed, failed, mentions written, scores updated."""
    return (
        reviews.agg(F.count("*").alias("reviews_fetched"))
        .withColumn("reviews_processed", processed.agg(F.count("*").alias("n")).scalar())
        .withColumn("reviews_failed", failed.agg(F.count("*").alias("n")).scalar())
        .withColumn("food_mentions_total", mentions.agg(F.count("*").alias("n")).scalar())
        .withColumn("food_scores_updated", scores.agg(F.count("*").alias("n")).scalar())
    )
