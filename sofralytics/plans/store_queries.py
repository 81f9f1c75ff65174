"""Backlog reads, exact dedup and upserts.

The upsert queries split a view by key into what is stored and what comes in: every key is in one or both,
so new, matched and untouched rows all occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.operators import dedup, scoring, upsert
from sofralytics.plans.registry import query
from sofralytics.sources import tables


@query(
    "backlog_reviews",
    "reviews_v",
    "platforms_v",
    sql="""SELECT review_id, p.restaurant_id, p.platform, md5(text) AS text_md5, CAST(rating AS INT) AS rating
           FROM reviews_v r JOIN platforms_v p USING (restaurant_platform_id)
           WHERE NOT processed AND text IS NOT NULL AND text <> '' ORDER BY review_id LIMIT 500""",
)
def backlog_reviews(t):
    return tables.backlog(t.reviews_v, t.platforms_v, 500).select(
        "review_id", "restaurant_id", "platform", F.md5("text").alias("text_md5"), F.col("rating").cast("int").alias("rating")
    )


@query(
    "labelling_input",
    "reviews_v",
    sql="""SELECT review_id, md5(text) AS text_md5, CAST(rating AS INT) AS star_rating FROM reviews_v
           WHERE text IS NOT NULL AND length(text) > 0 ORDER BY review_id LIMIT 1000""",
)
def labelling_input(t):
    return tables.labelled_reviews(t.reviews_v).select("review_id", F.md5("text").alias("text_md5"), F.col("star_rating").cast("int").alias("star_rating"))


@query(
    "open_reviews",
    "reviews_v",
    sql="""SELECT platform, count(*) AS open_reviews FROM reviews_v r
           WHERE NOT EXISTS (SELECT 1 FROM reviews_v d WHERE d.processed AND d.review_id = r.review_id) GROUP BY platform""",
)
def open_reviews(t):
    done = t.reviews_v.filter("processed").select("review_id")
    return tables.still_open(t.reviews_v, done).groupBy("platform").agg(F.count("*").alias("open_reviews"))


@query(
    "venue_first_seen",
    "bronze_venues_v",
    sql="""SELECT arrival, source, source_id FROM bronze_venues_v
           QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY arrival) = 1""",
)
def venue_first_seen(t):
    return dedup.first_venues(t.bronze_venues_v).select("arrival", "source", "source_id")


_WITH_ID = """(SELECT *, coalesce(external_review_id, substr(md5(trim(text)), 1, 16)) AS rid FROM bronze_reviews_v
    WHERE length(trim(text)) >= 3)"""


def _usable(t):
    return t.bronze_reviews_v.filter(F.length(F.trim("text")) >= 3)


@query(
    "review_first_seen",
    "bronze_reviews_v",
    sql=f"""SELECT arrival, restaurant_source_id, rid AS external_review_id FROM {_WITH_ID}
           QUALIFY row_number() OVER (PARTITION BY restaurant_source_id, rid ORDER BY arrival) = 1""",
)
def review_first_seen(t):
    return dedup.first_reviews(_usable(t)).select("arrival", "restaurant_source_id", "external_review_id")


@query(
    "reviews_capped_per_venue",
    "bronze_reviews_v",
    sql=f""", d AS (SELECT arrival, restaurant_source_id, rid FROM {_WITH_ID}
             QUALIFY row_number() OVER (PARTITION BY restaurant_source_id, rid ORDER BY arrival) = 1)
           SELECT arrival, restaurant_source_id, rid AS external_review_id FROM d
           QUALIFY row_number() OVER (PARTITION BY restaurant_source_id ORDER BY arrival, rid) <= 8""",
)
def reviews_capped_per_venue(t):
    return dedup.capped_reviews(_usable(t), 8).select("arrival", "restaurant_source_id", "external_review_id")


@query(
    "venues_not_stored",
    "bronze_venues_v",
    sql="""SELECT arrival FROM bronze_venues_v b WHERE NOT EXISTS (SELECT 1 FROM bronze_venues_v s
           WHERE s.arrival % 3 = 0 AND s.source = b.source AND s.source_id = b.source_id)""",
)
def venues_not_stored(t):
    stored = t.bronze_venues_v.filter("arrival % 3 = 0")
    return dedup.unseen(t.bronze_venues_v, stored, dedup.VENUE_KEY).select("arrival")


_VENUE_CHANGES = """SELECT v.slug, CASE WHEN n = 2 THEN concat(name, ' v2') ELSE name END AS name,
    CASE WHEN n = 1 THEN concat('new ', address) END AS address, CASE WHEN n = 2 THEN 1 END AS price_range,
    CASE WHEN n = 1 THEN overall_score END AS overall_score, n AS arrival
    FROM {venues} v, (SELECT 1 AS n UNION ALL SELECT 2) x WHERE v.restaurant_id % 3 <> 1"""


@query(
    "venue_upsert",
    "venues_v",
    sql=f""", changes AS ({_VENUE_CHANGES.replace('{venues}', 'venues_v')}),
           folded AS (SELECT slug, arg_max(name, arrival) AS name, arg_max(address, arrival) FILTER (WHERE address IS NOT NULL) AS address,
             arg_max(price_range, arrival) FILTER (WHERE price_range IS NOT NULL) AS price_range,
             arg_max(overall_score, arrival) FILTER (WHERE overall_score IS NOT NULL) AS overall_score FROM changes GROUP BY slug),
           stored AS (SELECT slug, name, address, price_range, overall_score FROM venues_v WHERE restaurant_id % 3 <> 0)
           SELECT coalesce(f.slug, s.slug) AS slug, CASE WHEN f.slug IS NOT NULL THEN f.name ELSE s.name END AS name,
             coalesce(f.address, s.address) AS address, CAST(coalesce(f.price_range, s.price_range) AS INT) AS price_range,
             CAST(coalesce(f.overall_score, s.overall_score) AS DOUBLE) AS overall_score
           FROM stored s FULL OUTER JOIN folded f ON s.slug = f.slug""",
)
def venue_upsert(t):
    venues = t.venues_v
    changes = t.spark.sql(_VENUE_CHANGES, venues=venues)
    stored = venues.filter("restaurant_id % 3 <> 0").select("slug", "name", "address", "price_range", "overall_score")
    out = upsert.upsert_venues(stored, changes)
    return out.select("slug", "name", "address", F.col("price_range").cast("int").alias("price_range"), F.col("overall_score").cast("double").alias("overall_score"))


@query(
    "platform_upsert",
    "platforms_v",
    sql=""", stored AS (SELECT platform, external_id, restaurant_id, 4.0 AS platform_score FROM platforms_v WHERE restaurant_id % 3 <> 0),
           fresh AS (SELECT platform, external_id, restaurant_id + 1000 AS restaurant_id,
                       CASE WHEN restaurant_id % 4 = 0 THEN 4.5 END AS platform_score FROM platforms_v WHERE restaurant_id % 3 <> 1)
           SELECT coalesce(f.platform, s.platform) AS platform, coalesce(f.external_id, s.external_id) AS external_id,
             coalesce(f.restaurant_id, s.restaurant_id) AS restaurant_id, CAST(coalesce(f.platform_score, s.platform_score) AS DOUBLE) AS platform_score
           FROM stored s FULL OUTER JOIN fresh f ON s.platform = f.platform AND s.external_id = f.external_id""",
)
def platform_upsert(t):
    rows = t.platforms_v
    stored = rows.filter("restaurant_id % 3 <> 0").select("platform", "external_id", "restaurant_id", F.lit(4.0).alias("platform_score"))
    fresh = rows.filter("restaurant_id % 3 <> 1").select(
        "platform", "external_id", (F.col("restaurant_id") + 1000).alias("restaurant_id"),
        F.when(F.col("restaurant_id") % 4 == 0, 4.5).alias("platform_score"), F.lit(1).alias("arrival"),
    )
    return upsert.upsert_platforms(stored, fresh)


_INCOMING = f"""incoming AS (SELECT arrival, restaurant_source, restaurant_source_id, rid AS external_review_id, text, language FROM {_WITH_ID}
             WHERE true),
           known AS (SELECT platform, external_id, restaurant_platform_id FROM platforms_v WHERE restaurant_id % 5 <> 0)"""


def _incoming(t):
    fresh = dedup.with_review_id(_usable(t)).select(
        "arrival", "restaurant_source", "restaurant_source_id", "external_review_id", "text", "language"
    )
    known = t.platforms_v.filter("restaurant_id % 5 <> 0")
    return upsert.link_reviews(fresh, known)


@query(
    "review_upsert",
    "bronze_reviews_v",
    "platforms_v",
    "reviews_v",
    sql=f""", {_INCOMING},
           folded AS (SELECT restaurant_platform_id, external_review_id, arg_max(text, arrival) AS text,
               arg_max(language, arrival) FILTER (WHERE language IS NOT NULL) AS language
               FROM incoming i JOIN known k ON i.restaurant_source = k.platform AND i.restaurant_source_id = k.external_id GROUP BY 1, 2),
           stored AS (SELECT restaurant_platform_id, external_review_id, concat('old ', text) AS text, language, processed FROM reviews_v
             WHERE review_id % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY restaurant_platform_id, external_review_id ORDER BY review_id) = 1)
           SELECT coalesce(f.restaurant_platform_id, s.restaurant_platform_id) AS restaurant_platform_id,
             coalesce(f.external_review_id, s.external_review_id) AS external_review_id,
             md5(coalesce(f.text, s.text)) AS text_md5, coalesce(f.language, s.language) AS language, coalesce(s.processed, false) AS processed
           FROM stored s FULL OUTER JOIN folded f USING (restaurant_platform_id, external_review_id)""",
)
def review_upsert(t):
    linked, _ = _incoming(t)
    stored = dedup.first_per_key(
        t.reviews_v.filter("review_id % 3 <> 1"), ["restaurant_platform_id", "external_review_id"], ["review_id"]
    ).select("restaurant_platform_id", "external_review_id", F.concat(F.lit("old "), "text").alias("text"), "language", "processed")
    out = upsert.upsert_reviews(stored, linked)
    return out.select("restaurant_platform_id", "external_review_id", F.md5("text").alias("text_md5"), "language", "processed")


@query(
    "orphan_reviews",
    "bronze_reviews_v",
    "platforms_v",
    "reviews_v",
    sql=f""", {_INCOMING} SELECT arrival, restaurant_source, restaurant_source_id FROM incoming i
           WHERE NOT EXISTS (SELECT 1 FROM known k WHERE i.restaurant_source = k.platform AND i.restaurant_source_id = k.external_id)""",
)
def orphan_reviews(t):
    _, orphans = _incoming(t)
    return orphans.select("arrival", "restaurant_source", "restaurant_source_id")


@query(
    "score_upsert",
    "scores_v",
    sql="""SELECT restaurant_id, food, score, review_count FROM scores_v WHERE restaurant_id % 3 <> 1
           UNION ALL SELECT restaurant_id, food, 1.0 AS score, 0 AS review_count FROM scores_v WHERE restaurant_id % 3 = 1""",
)
def score_upsert(t):
    scores = scoring.score_dishes(t.mentions_v).select("restaurant_id", "food", "score", "review_count")
    stored = scores.filter("restaurant_id % 3 <> 0").select(
        "restaurant_id", "food", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("review_count")
    )
    return upsert.upsert_scores(stored, scores.filter("restaurant_id % 3 <> 1"))


@query(
    "review_recount",
    "venues_v",
    "reviews_v",
    sql="""SELECT restaurant_id, coalesce(n, 0) AS total_reviews FROM venues_v LEFT JOIN
           (SELECT restaurant_id, count(*) AS n FROM reviews_v GROUP BY restaurant_id) USING (restaurant_id)""",
)
def review_recount(t):
    return upsert.recount_reviews(t.venues_v, t.reviews_v).select("restaurant_id", "total_reviews")
