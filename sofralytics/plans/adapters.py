"""Views that give the driver tables the shapes of venues, reviews, mentions and request logs.

Each view is one SQL text valid in Spark and in the checking engine, with ``{table}`` marking an input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# view -> (inputs, text)
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "venues_v": (
        ("supplier", "nation"),
        """
        SELECT s.s_suppkey AS restaurant_id,
               s.s_name AS name,
               lower(replace(s.s_name, '#', '-')) AS slug,
               concat('No ', CAST(s.s_suppkey % 50 AS STRING), ' Street ', CAST(s.s_suppkey % 13 AS STRING),
                      ' ', n.n_name) AS address,
               n.n_name AS district,
               CASE s.s_suppkey % 4 WHEN 0 THEN 'turk,kebap' WHEN 1 THEN 'balik' WHEN 2 THEN 'pide_lahmacun,turk'
                    ELSE NULL END AS cuisine_tags,
               CAST(1 + s.s_suppkey % 4 AS INT) AS price_range,
               CAST(CASE WHEN s.s_suppkey % 10 = 9 THEN NULL
                         ELSE 1 + (s.s_suppkey * 37 % 900) / 100.0 END AS DECIMAL(4,2)) AS overall_score,
               s.s_suppkey * 13 % 500 AS total_reviews,
               s.s_suppkey % 7 <> 0 AS is_active,
               CAST(40.80 + (s.s_suppkey * 37 % 400) / 1000.0 AS DOUBLE) AS lat,
               CAST(28.60 + (s.s_suppkey * 53 % 550) / 1000.0 AS DOUBLE) AS lng,
               DATE '2024-01-01' + CAST(s.s_suppkey % 300 AS INT) AS created_at
        FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
        """,
    ),
    "mentions_v": (
        ("lineitem", "part"),
        """
        SELECT l.l_orderkey AS review_id,
               l.l_linenumber AS mention_no,
               l.l_suppkey AS restaurant_id,
               lower(p.p_name) AS food,
               p.p_type AS category,
               CASE l.l_returnflag WHEN 'N' THEN 'positive' WHEN 'A' THEN 'neutral'
                    WHEN 'R' THEN 'negative' END AS sentiment,
               CAST(0.40 + l.l_discount * 5 AS DECIMAL(4,3)) AS confidence,
               CAST(1 + floor((l.l_quantity - 1) / 10) AS INT) AS star_rating,
               l.l_linestatus = 'O' AS is_food,
               l.l_shipdate AS mention_ts
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
        """,
    ),
    "reviews_v": (
        ("documents", "labels"),
        """
        SELECT d.doc_id AS review_id,
               d.doc_id % 97 AS restaurant_id,
               d.source AS platform,
               d.doc_id % 97 * 100 + CAST(substr(d.source, 4) AS INT) AS restaurant_platform_id,
               concat('r', CAST(d.doc_id % 700 AS STRING)) AS external_review_id,
               d.text AS text,
               d.lang AS language,
               CASE WHEN b.quality = 1 AND b.toxic = 0 THEN 5
                    WHEN b.quality = 1 AND b.toxic = 1 THEN 2
                    WHEN b.quality = 0 AND b.toxic = 0 THEN 3
                    WHEN b.quality = 0 AND b.toxic = 1 THEN 1 END AS rating,
               CASE WHEN d.doc_id % 11 = 0 THEN NULL
                    ELSE DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT) END AS review_date,
               d.doc_id % 3 = 0 AS processed
        FROM {documents} d LEFT JOIN {labels} b ON d.doc_id = b.doc_id
        """,
    ),
    "platforms_v": (
        ("reviews_v",),
        """
        SELECT DISTINCT restaurant_platform_id, restaurant_id, platform,
               concat('ext-', CAST(restaurant_id AS STRING)) AS external_id
        FROM {reviews_v}
        """,
    ),
    "dishes_v": (
        ("part",),
        """
        SELECT min(p_partkey) AS dish_id, lower(p_name) AS name, min(p_type) AS category
        FROM {part} GROUP BY lower(p_name)
        """,
    ),
    "named_dishes_v": (
        ("dishes_v",),
        """
        SELECT dish_id, CASE WHEN dish_id % 3 = 0 THEN concat('usta ', name) ELSE name END AS name,
               CASE WHEN dish_id % 3 = 0 THEN name END AS canonical_name, replace(name, ' ', '-') AS slug, category
        FROM {dishes_v}
        """,
    ),
    "bronze_venues_v": (
        ("supplier", "nation"),
        """
        SELECT s.s_suppkey AS arrival,
               CASE s.s_suppkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE concat('  ', s.s_name, ' ') END AS name,
               CASE s.s_suppkey % 19 WHEN 2 THEN '' ELSE concat('src', CAST(s.s_suppkey % 4 AS STRING)) END AS source,
               CASE s.s_suppkey % 23 WHEN 3 THEN NULL ELSE concat('id', CAST(s.s_suppkey % 60 AS STRING)) END AS source_id,
               concat(' ', n.n_name, ' sokak ', CAST(s.s_suppkey AS STRING), ' ') AS address,
               n.n_name AS district,
               concat('+90 (', CAST(212 + s.s_suppkey % 5 AS STRING), ') ',
                      CAST(1000000 + s.s_suppkey * 7919 % 8999999 AS STRING), ' - x') AS phone,
               CASE s.s_suppkey % 9 WHEN 4 THEN 'x' WHEN 5 THEN NULL
                    ELSE CAST(40.80 + (s.s_suppkey * 37 % 400) / 1000.0 AS STRING) END AS latitude,
               CASE s.s_suppkey % 8 WHEN 3 THEN NULL
                    ELSE CAST(28.60 + (s.s_suppkey * 53 % 550) / 1000.0 AS STRING) END AS longitude,
               CASE s.s_suppkey % 3 WHEN 0 THEN '2024-03-05T10:20:30Z' WHEN 1 THEN NULL ELSE 'yesterday' END AS scraped_at,
               CASE s.s_suppkey % 2 WHEN 0 THEN 'https://img.example/1.png' ELSE 'data:image/png;base64,AAAA' END AS image_url
        FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
        """,
    ),
    "bronze_reviews_v": (
        ("documents",),
        """
        SELECT doc_id AS arrival,
               CASE doc_id % 29 WHEN 0 THEN NULL ELSE source END AS restaurant_source,
               concat('ext-', CAST(doc_id % 97 AS STRING)) AS restaurant_source_id,
               CASE doc_id % 37 WHEN 5 THEN NULL ELSE concat('r', CAST(doc_id % 700 AS STRING)) END AS external_review_id,
               CASE doc_id % 31 WHEN 0 THEN ' a ' WHEN 1 THEN '' ELSE text END AS text,
               CASE doc_id % 7 WHEN 0 THEN '4' WHEN 1 THEN '9' WHEN 2 THEN '-1' WHEN 3 THEN 'abc'
                    WHEN 5 THEN ' 3 ' WHEN 6 THEN '4.5' END AS rating,
               CASE doc_id % 6
                    WHEN 0 THEN concat('2024-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-15')
                    WHEN 1 THEN concat('15.', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '.2024')
                    WHEN 2 THEN concat('15/', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '/2024')
                    WHEN 3 THEN concat('2024-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-15T08:30:00Z')
                    WHEN 4 THEN 'last year' END AS review_date,
               CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang END AS language,
               CASE doc_id % 3 WHEN 0 THEN '2024-03-05T10:20:30Z' WHEN 1 THEN NULL ELSE 'yesterday' END AS scraped_at
        FROM {documents}
        """,
    ),
    "vectors_v": (
        ("embeddings",),
        """
        SELECT vec_id AS review_id, embedding, label % 3 - 1 AS label FROM {embeddings}
        """,
    ),
    "dictionary_v": (
        ("benchmark",),
        """
        SELECT item_id AS load_position,
               concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) AS canonical,
               split_part(text, ' ', 3) AS alias_1,
               concat(split_part(text, ' ', 4), ' ', split_part(text, ' ', 5)) AS alias_2,
               concat('cat', CAST(item_id % 5 AS STRING)) AS category,
               concat('region', CAST(item_id % 3 AS STRING)) AS region
        FROM {benchmark}
        """,
    ),
    "requests_v": (
        ("events",),
        """
        SELECT event_id AS request_id, ts, user_id AS client, event_type AS platform,
               event_type = 'error' AND event_id % 5 IN (0, 1, 3) AS failure, value AS wait_s,
               CASE event_type WHEN 'error' THEN
                      CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 0 ELSE 503 END
                    WHEN 'signup' THEN 404 ELSE 200 END AS status,
               CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN value END AS retry_after_s
        FROM {events}
        """,
    ),
}


def for_spark(text: str) -> str:
    """The text with divisors such as 1000.0 as doubles: Spark would divide them as exact decimals, the checking engine does not."""
    return re.sub(r"(/ \d+\.\d+)(?![\w.])", r"\1D", text)


class Tables:
    """Driver tables of one folder and the views over them; nothing is read until a plan runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEW_SQL:
            needs, text = VIEW_SQL[name]
            return self.spark.sql(for_spark(text), **{need: getattr(self, need) for need in needs})
        raise AttributeError(name)
