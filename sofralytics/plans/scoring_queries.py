"""Dish scores, ranks and reports over the mention view."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.operators import scoring
from sofralytics.plans.adapters import VIEW_SQL
from sofralytics.plans.registry import query, rounded, stripped

_SENTIMENT = "CASE sentiment WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0 WHEN 'negative' THEN -1 END"
_STAR = "(greatest(1.0, least(5.0, CAST(star_rating AS DOUBLE))) - 3.0) / 2.0"


def score_sql(source: str = "mentions_v") -> str:
    combined = "coalesce(sws / nullif(sw, 0), 0) * 0.7 + coalesce(sst / nullif(sw_star, 0), 0) * 0.3"
    score = rounded(f"(greatest(-1.0, least(1.0, {combined})) + 1.0) / 2.0 * 9.0 + 1.0", 2)
    conf = "coalesce(sw / nullif(usable, 0), 0)"
    count = "positive_count + neutral_count + negative_count"
    return f"""
        SELECT restaurant_id, food, {score} AS score,
               {rounded(f"CASE WHEN {count} < 3 THEN {conf} * ({count}) / 3.0 ELSE {conf} END", 4)} AS confidence,
               positive_count, neutral_count, negative_count, {count} AS review_count, {count} >= 3 AS enough_data
        FROM (
          SELECT restaurant_id, lower({stripped('food')}) AS food,
                 count(*) FILTER (WHERE sentiment = 'positive') AS positive_count,
                 count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
                 count(*) FILTER (WHERE sentiment = 'negative') AS negative_count,
                 count(*) FILTER (WHERE sentiment IS NOT NULL AND confidence >= 0.5) AS usable,
                 CAST(sum(confidence) FILTER (WHERE sentiment IS NOT NULL AND confidence >= 0.5) AS DOUBLE) AS sw,
                 CAST(sum(confidence * ({_SENTIMENT})) FILTER (WHERE confidence >= 0.5) AS DOUBLE) AS sws,
                 CAST(sum(confidence) FILTER (WHERE sentiment IS NOT NULL AND confidence >= 0.5
                                              AND star_rating IS NOT NULL) AS DOUBLE) AS sw_star,
                 sum(CAST(confidence AS DOUBLE) * {_STAR})
                   FILTER (WHERE sentiment IS NOT NULL AND confidence >= 0.5) AS sst
          FROM {source} WHERE {stripped('food')} <> '' GROUP BY restaurant_id, lower({stripped('food')}))
    """


# Spark reads the same view through the operator, not through this text.
VIEW_SQL["scores_v"] = (("mentions_v",), score_sql("{mentions_v}"))


@query("dish_scores", "scores_v", sql="SELECT * FROM scores_v")
def dish_scores(t):
    return scoring.score_dishes(t.mentions_v)


@query(
    "dish_rank",
    "scores_v",
    sql="""SELECT restaurant_id, row_number() OVER (PARTITION BY restaurant_id ORDER BY review_count >= 3 DESC,
             CASE WHEN review_count >= 3 THEN score ELSE CAST(review_count AS DOUBLE) END DESC, food) AS rank,
             food, score, confidence, review_count, review_count >= 3 AS enough_data FROM scores_v""",
)
def dish_rank(t):
    return scoring.rank_dishes(scoring.score_dishes(t.mentions_v))


@query(
    "score_components",
    "mentions_v",
    sql=f"""SELECT sentiment, star_rating, count(*) AS n,
             CAST(CASE sentiment WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0 ELSE -1 END AS DOUBLE) AS sentiment_value,
             {_STAR} AS star_value,
             {rounded("(" + _STAR + " + 1.0) / 2.0 * 9.0 + 1.0", 4)} AS star_on_ten
             FROM mentions_v GROUP BY ALL""",
)
def score_components(t):
    """Counts of each label and star pair with their numeric values."""
    from sofralytics.functions.numeric import round_to

    star = scoring.star_value(F.col("star_rating"))
    return t.mentions_v.groupBy("sentiment", "star_rating").agg(F.count("*").alias("n")).select(
        "sentiment", "star_rating", "n",
        scoring.sentiment_value(F.col("sentiment")).cast("double").alias("sentiment_value"),
        star.alias("star_value"),
        round_to(scoring.scale_to_ten(star), 4).alias("star_on_ten"),
    )


@query(
    "weighted_mean_by_category",
    "mentions_v",
    sql=f"""SELECT category, {rounded("coalesce(sum(confidence * star_rating) / nullif(CAST(sum(confidence) AS DOUBLE), 0), 0)", 4)}
             AS weighted_stars FROM mentions_v GROUP BY category""",
)
def weighted_mean_by_category(t):
    """Confidence-weighted mean star rating of every category."""
    from sofralytics.functions.numeric import round_to

    sums = t.mentions_v.groupBy("category").agg(
        F.sum(F.col("confidence") * F.col("star_rating")).cast("double").alias("wv"),
        F.sum("confidence").cast("double").alias("w"),
    )
    return sums.select("category", round_to(scoring.weighted_mean(F.col("wv"), F.col("w")), 4).alias("weighted_stars"))


@query(
    "score_report_summary",
    "scores_v",
    sql=f"""SELECT restaurant_id, count(*) AS dish_count, CAST(sum(review_count) AS BIGINT) AS total_reviews,
             count(*) FILTER (WHERE review_count >= 3) AS enough_count,
             count(*) FILTER (WHERE review_count < 3) AS thin_count,
             {rounded("avg(score) FILTER (WHERE review_count > 0)", 1)} AS mean_score
             FROM scores_v GROUP BY restaurant_id""",
)
def score_report_summary(t):
    return scoring.score_summary(scoring.score_dishes(t.mentions_v))


@query(
    "score_report_best_worst",
    "scores_v",
    sql=""", r AS (SELECT restaurant_id, food, score, review_count,
               row_number() OVER (PARTITION BY restaurant_id ORDER BY score DESC, food) AS b,
               row_number() OVER (PARTITION BY restaurant_id ORDER BY score, food DESC) AS w,
               count(*) OVER (PARTITION BY restaurant_id) AS n
             FROM scores_v WHERE review_count >= 3)
           SELECT restaurant_id, food, score, review_count, CAST(b AS INT) AS position, 'best' AS list FROM r WHERE b <= 5
           UNION ALL
           SELECT restaurant_id, food, score, review_count, CAST(w AS INT) AS position, 'worst' AS list FROM r
           WHERE w <= 5 AND n > 1""",
)
def score_report_best_worst(t):
    return scoring.best_and_worst(scoring.score_dishes(t.mentions_v))


@query(
    "score_report_thin_data",
    "scores_v",
    sql="SELECT restaurant_id, food, score, review_count FROM scores_v WHERE review_count < 3",
)
def score_report_thin_data(t):
    return scoring.thin_data(scoring.score_dishes(t.mentions_v))


@query(
    "venue_dish_mart",
    "mentions_v",
    "scores_v",
    sql=f"""SELECT restaurant_id, food,
             {rounded("(positive_count - negative_count) / nullif(CAST(review_count AS DOUBLE), 0)", 2)} AS avg_sentiment,
             positive_count, negative_count, neutral_count, review_count AS total_mentions, score AS computed_score
             FROM scores_v""",
)
def venue_dish_mart(t):
    return scoring.venue_dish_mart(t.mentions_v)


@query(
    "run_totals",
    "reviews_v",
    "mentions_v",
    "scores_v",
    sql="""SELECT (SELECT count(*) FROM reviews_v) AS reviews_fetched,
             (SELECT count(*) FROM reviews_v WHERE length(trim(text)) >= 3) AS reviews_processed,
             (SELECT count(*) FROM reviews_v WHERE text IS NULL OR length(trim(text)) < 3) AS reviews_failed,
             (SELECT count(*) FROM mentions_v) AS food_mentions_total,
             (SELECT count(*) FROM scores_v) AS food_scores_updated""",
)
def run_totals(t):
    reviews, mentions = t.reviews_v, t.mentions_v
    usable = F.length(F.trim("text")) >= 3
    return scoring.batch_totals(
        reviews,
        reviews.filter(usable),
        reviews.filter(F.col("text").isNull() | ~usable),
        mentions,
        scoring.score_dishes(mentions).select("food"),
    )


@query("running_dish_scores", "scores_v", sql="SELECT * FROM scores_v")
def running_dish_scores(t):
    """Scores from the merged sums of two batches that together hold every mention."""
    first = scoring.dish_sums(t.mentions_v.filter("mention_no % 2 = 0"))
    second = scoring.dish_sums(t.mentions_v.filter("mention_no % 2 = 1"))
    return scoring.finish_scores(scoring.merge_sums(first, second))
