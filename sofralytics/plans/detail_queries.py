"""Venue and dish detail over all venues and dishes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.operators import detail, scoring
from sofralytics.plans.registry import query, rounded

def _links(t):
    """Mentions tied to the review rows of the documents, so the three-way join has matches."""
    ids = t.documents.agg((F.max("doc_id") + 1).alias("n")).scalar()
    return t.mentions_v.withColumn("review_id", F.col("review_id") % ids)


_LINKED = "linked AS (SELECT * REPLACE (review_id % (SELECT max(doc_id) + 1 FROM documents) AS review_id) FROM mentions_v)"
_COUNTS = """count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
    count(*) FILTER (WHERE sentiment = 'neutral') AS neutral"""


@query("venue_by_slug", "venues_v", sql="SELECT restaurant_id, name FROM venues_v WHERE slug = 'supplier-000000008' AND is_active LIMIT 1")
def venue_by_slug(t):
    return detail.venue_by_slug(t.venues_v, "supplier-000000008").select("restaurant_id", "name")


@query(
    "venue_platforms",
    "venues_v",
    "platforms_v",
    sql="SELECT p.* FROM platforms_v p WHERE EXISTS (SELECT 1 FROM venues_v v WHERE v.restaurant_id = p.restaurant_id AND v.is_active)",
)
def venue_platforms(t):
    return detail.venue_platforms(t.venues_v, t.platforms_v)


@query(
    "venue_scores",
    "scores_v",
    sql="""SELECT restaurant_id, food, score, review_count, row_number() OVER (PARTITION BY restaurant_id ORDER BY score DESC NULLS FIRST, food) AS position FROM scores_v""",
)
def venue_scores(t):
    return detail.venue_scores(scoring.score_dishes(t.mentions_v))


_RECENT = """recent AS (SELECT p.restaurant_id, p.platform, r.review_id, r.review_date, CAST(row_number() OVER (PARTITION BY p.restaurant_id
    ORDER BY r.review_date DESC NULLS FIRST, r.review_id) AS INT) AS position FROM reviews_v r JOIN platforms_v p USING (restaurant_platform_id) QUALIFY position <= 10)"""


@query("recent_reviews", "reviews_v", "platforms_v", sql=f", {_RECENT} SELECT restaurant_id, platform, review_id, CAST(review_date AS DATE) AS review_date, position FROM recent")
def recent_reviews(t):
    return detail.recent_reviews(t.reviews_v, t.platforms_v).select(
        "restaurant_id", "platform", "review_id", F.col("review_date").cast("date").alias("review_date"), "position"
    )


_SENTIMENT = f"""{_LINKED}, sums AS (SELECT p.restaurant_id, {_COUNTS} FROM linked m JOIN reviews_v r USING (review_id)
    JOIN platforms_v p ON r.restaurant_platform_id = p.restaurant_platform_id GROUP BY p.restaurant_id)"""


@query("venue_sentiment", "mentions_v", "reviews_v", "platforms_v", sql=f", {_SENTIMENT} SELECT * FROM sums")
def venue_sentiment(t):
    return detail.venue_sentiment(_links(t), t.reviews_v, t.platforms_v)


@query(
    "venue_sentiment_summary",
    "mentions_v",
    "reviews_v",
    "platforms_v",
    sql=f""", {_SENTIMENT}, pct AS (SELECT *, CAST(floor(100.0::DOUBLE * positive / total + 0.5) AS BIGINT) AS positive_pct,
             CAST(floor(100.0::DOUBLE * negative / total + 0.5) AS BIGINT) AS negative_pct FROM sums)
           SELECT *, 100 - positive_pct - negative_pct AS neutral_pct, CASE WHEN positive_pct >= 60 THEN 'positive' WHEN negative_pct >= 40 THEN 'negative'
             WHEN total = 0 THEN 'neutral' ELSE 'mixed' END AS overall FROM pct""",
)
def venue_sentiment_summary(t):
    return detail.sentiment_summary(detail.venue_sentiment(_links(t), t.reviews_v, t.platforms_v))


@query(
    "mentioned_dishes",
    "mentions_v",
    "reviews_v",
    "platforms_v",
    sql=f""", {_LINKED}, {_RECENT} SELECT review_id, coalesce(food, 'Bilinmeyen') AS dish_name, sentiment, count(*) AS times FROM linked
           WHERE review_id IN (SELECT review_id FROM recent) GROUP BY ALL""",
)
def mentioned_dishes(t):
    return detail.mentioned_dishes(detail.recent_reviews(t.reviews_v, t.platforms_v), _links(t))


@query(
    "venue_documents",
    "venues_v",
    "mentions_v",
    "reviews_v",
    "platforms_v",
    "scores_v",
    sql=f""", {_SENTIMENT}, {_RECENT},
           pl AS (SELECT restaurant_id, count(*) AS platforms FROM platforms_v GROUP BY 1),
           sc AS (SELECT restaurant_id, count(*) AS dishes, arg_min(food, (-score, food)) AS best_dish FROM scores_v GROUP BY 1),
           rv AS (SELECT restaurant_id, count(*) AS recent, array_to_string(array_agg(review_id ORDER BY position), '|') AS review_ids FROM recent GROUP BY 1)
           SELECT restaurant_id, v.name, platforms, dishes, best_dish, recent, review_ids, total AS analysed FROM venues_v v LEFT JOIN pl USING (restaurant_id)
           LEFT JOIN sc USING (restaurant_id) LEFT JOIN rv USING (restaurant_id) LEFT JOIN sums USING (restaurant_id) WHERE v.is_active""",
)
def venue_documents(t):
    out = detail.venue_documents(t.venues_v, t.platforms_v, scoring.score_dishes(t.mentions_v), t.reviews_v, _links(t))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    return out.select(
        "restaurant_id", "name", size("platforms").alias("platforms"), size("food_scores").alias("dishes"),
        F.col("food_scores")[0]["food"].alias("best_dish"), size("recent_reviews").alias("recent"),
        F.when(F.col("recent_reviews").isNotNull(), F.array_join(F.transform("recent_reviews", lambda r: r["review_id"].cast("string")), "|")).alias("review_ids"),
        F.col("sentiment_summary.total").alias("analysed"),
    )


_SERVED = """served AS (SELECT d.dish_id, d.name AS dish, s.restaurant_id, s.score, s.review_count, v.name AS venue, v.slug, v.district
    FROM scores_v s JOIN venues_v v USING (restaurant_id) JOIN dishes_v d ON d.name = s.food WHERE v.is_active)"""


def _served(t):
    return detail.dish_venues(t.dishes_v, scoring.score_dishes(t.mentions_v), t.venues_v)


@query("dish_venues", "dishes_v", "venues_v", "scores_v", sql=f", {_SERVED} SELECT * FROM served")
def dish_venues(t):
    return _served(t).select("dish_id", "dish", "restaurant_id", "score", "review_count", "venue", "slug", "district")


_STATS = f"""{_SERVED}, stats AS (SELECT dish_id, {rounded('avg(score)', 2)} AS avg_score, max(score) AS max_score, min(score) AS min_score,
    CAST(sum(review_count) AS BIGINT) AS total_reviews, count(DISTINCT restaurant_id) AS venues FROM served GROUP BY dish_id)"""


@query(
    "dish_stats",
    "dishes_v",
    "venues_v",
    "scores_v",
    sql=f", {_STATS} SELECT dish_id, name, avg_score, max_score, min_score, coalesce(total_reviews, 0) AS total_reviews, coalesce(venues, 0) AS venues FROM dishes_v LEFT JOIN stats USING (dish_id)",
)
def dish_stats(t):
    return detail.dish_stats(t.dishes_v, _served(t))


@query("dish_sentiment", "dishes_v", "mentions_v", sql=f"SELECT dish_id, name, {_COUNTS} FROM dishes_v JOIN mentions_v ON food = name GROUP BY dish_id, name")
def dish_sentiment(t):
    return detail.dish_sentiment(t.dishes_v, t.mentions_v)


@query(
    "best_venues_per_dish",
    "dishes_v",
    "venues_v",
    "scores_v",
    sql=f""", {_SERVED} SELECT dish_id, restaurant_id, score, CAST(row_number() OVER (PARTITION BY dish_id ORDER BY score DESC NULLS FIRST, restaurant_id) AS INT) AS position
           FROM served QUALIFY position <= 20""",
)
def best_venues_per_dish(t):
    return detail.best_venues(_served(t)).select("dish_id", "restaurant_id", "score", "position")



_BY_KEY = _SERVED.replace("JOIN dishes_v d ON d.name = s.food", "JOIN named_dishes_v d ON coalesce(d.canonical_name, d.name) = s.food")


@query(
    "dish_documents",
    "named_dishes_v",
    "venues_v",
    "scores_v",
    "mentions_v",
    sql=f""", {_STATS.replace(_SERVED, _BY_KEY)},
           ranked AS (SELECT *, row_number() OVER (PARTITION BY dish_id ORDER BY score DESC NULLS FIRST, restaurant_id) AS position FROM served),
           lists AS (SELECT dish_id, string_agg(concat_ws('|', restaurant_id, venue, slug, district, coalesce(CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR), '-'), review_count), ';' ORDER BY position) AS venues
             FROM ranked WHERE position <= 20 GROUP BY dish_id),
           felt AS (SELECT dish_id, {_COUNTS} FROM named_dishes_v d JOIN mentions_v ON food = coalesce(canonical_name, name) GROUP BY dish_id)
           SELECT d.dish_id, d.slug, d.name, d.category, l.venues, s.avg_score, s.max_score, s.min_score, coalesce(s.total_reviews, 0) AS total_reviews, coalesce(s.venues, 0) AS venue_count,
             coalesce(f.total, 0) AS total, coalesce(f.positive, 0) AS positive, coalesce(f.negative, 0) AS negative, coalesce(f.neutral, 0) AS neutral
           FROM named_dishes_v d LEFT JOIN lists l USING (dish_id) LEFT JOIN stats s USING (dish_id) LEFT JOIN felt f USING (dish_id)""",
)
def dish_documents(t):
    """Dish documents, a third of the dishes known by a canonical name, with the whole list of venues spelt out."""
    out = detail.dish_documents(t.named_dishes_v, scoring.score_dishes(t.mentions_v), t.venues_v, t.mentions_v)
    line = lambda v: F.concat_ws("|", v["restaurant_id"], v["venue"], v["slug"], v["district"], F.coalesce(F.round(v["score"] * 100).cast("long").cast("string"), F.lit("-")), v["review_count"])
    return out.select("dish_id", "slug", "name", "category", F.array_join(F.transform("venues", line), ";").alias("venues"), "stats.*", "sentiment.*")
