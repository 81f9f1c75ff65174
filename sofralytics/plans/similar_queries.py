"""Near-duplicate names, venue matches and misspelt dishes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.functions.numeric import round_to
from sofralytics.operators import dictionary as dish
from sofralytics.operators import similar
from sofralytics.plans.dictionary_queries import dish_dictionary
from sofralytics.plans.registry import query, rounded

# Common-subsequence length of each pair in ``pairs(a, b)`` (texts of up to 60 characters), one character of b per step.
_LCS = """masks AS (SELECT a, c, CAST(sum(CAST(1 AS BIGINT) << (i - 1)) AS BIGINT) AS m FROM
      (SELECT a, i, substr(a, CAST(i AS INT), 1) AS c FROM (SELECT a, unnest(range(1, length(a) + 1)) AS i FROM (SELECT DISTINCT a FROM pairs))) GROUP BY a, c),
    walk(a, b, i, v) AS (
      SELECT a, b, 0, (CAST(1 AS BIGINT) << length(a)) - 1 FROM pairs
      UNION ALL
      SELECT w.a, w.b, w.i + 1, ((v + (v & coalesce(m, 0))) | (v - (v & coalesce(m, 0)))) & ((CAST(1 AS BIGINT) << length(w.a)) - 1)
      FROM walk w LEFT JOIN masks k ON k.a = w.a AND k.c = substr(w.b, w.i + 1, 1) WHERE w.i < length(w.b)),
    ratios AS (SELECT a, b, 200.0::DOUBLE * (length(a) - bit_count(v)) / (length(a) + length(b)) AS r FROM walk WHERE i = length(b))"""
_KEY = "array_to_string(list_sort(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')), ' ')"


@query(
    "fuzzy_duplicates",
    recursive=True,
    sql=f"""WITH keyed AS (SELECT p_partkey AS id, {_KEY.format(c="concat(p_name, ' ', p_type)")} AS key FROM part),
           pairs AS (SELECT x.key AS a, y.key AS b FROM (SELECT DISTINCT key FROM keyed) x, (SELECT DISTINCT key FROM keyed) y WHERE x.key < y.key
             AND 200 * least(length(x.key), length(y.key)) >= 85 * (length(x.key) + length(y.key))), {_LCS},
           near AS (SELECT a, b, r FROM ratios WHERE r >= 85 UNION ALL SELECT b, a, r FROM ratios WHERE r >= 85
             UNION ALL SELECT key, key, 100.0 FROM (SELECT DISTINCT key FROM keyed))
           SELECT s.id AS source_id, t.id AS target_id, {rounded('r', 6)} AS score, CASE WHEN r = 100 THEN 'exact' ELSE 'fuzzy' END AS match_type
           FROM keyed s JOIN near ON near.a = s.key JOIN keyed t ON t.key = near.b AND t.id > s.id
           QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY r DESC, t.id) <= 5""",
)
def fuzzy_duplicates(t):
    records = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return similar.find_duplicates(records).withColumn("score", round_to(F.col("score"), 6))


_SOURCES = """SELECT s_suppkey AS id, concat(CASE s_suppkey % 3 WHEN 0 THEN 'Koy Evi ' WHEN 1 THEN 'Deniz Restoran ' ELSE 'Ocakbasi ' END, CAST(s_suppkey % 40 AS STRING)) AS name,
    concat('Sokak ', CAST(s_suppkey % 25 AS STRING), ' No ', CAST(s_suppkey % 9 AS STRING)) AS address,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('+90212', CAST(s_suppkey % 30 AS STRING)) END AS phone FROM {supplier}"""
_TARGETS = """SELECT s_suppkey AS id, concat(CAST(s_suppkey % 40 AS STRING), CASE s_suppkey % 3 WHEN 0 THEN ' Koy Evi' WHEN 1 THEN ' Deniz Restaurant' ELSE ' Ocakbas' END) AS name,
    concat('Sokak ', CAST(s_suppkey % 26 AS STRING), ' No: ', CAST(s_suppkey % 9 AS STRING)) AS address,
    concat('+90212', CAST(s_suppkey % 31 AS STRING)) AS phone FROM {supplier}"""


@query(
    "venue_matches",
    recursive=True,
    sql=f"""WITH s AS (SELECT id, {_KEY.format(c='name')} AS n, {_KEY.format(c='address')} AS d, phone FROM ({_SOURCES.replace('{supplier}', 'supplier')})),
           t AS (SELECT id, {_KEY.format(c='name')} AS n, {_KEY.format(c='address')} AS d, phone FROM ({_TARGETS.replace('{supplier}', 'supplier')})),
           pairs AS (SELECT DISTINCT s.n AS a, t.n AS b FROM s, t UNION SELECT DISTINCT s.d, t.d FROM s, t), {_LCS},
           scored AS (SELECT s.id AS source_id, t.id AS target_id, x.r AS name_similarity, y.r AS address_similarity, coalesce(s.phone = t.phone, false) AS phone_match,
               x.r * 0.35 + y.r * 0.30 + 50 * 0.25 + CASE WHEN s.phone = t.phone THEN 10.0 ELSE 0.0 END AS confidence
             FROM s, t JOIN ratios x ON x.a = s.n AND x.b = t.n JOIN ratios y ON y.a = s.d AND y.b = t.d WHERE x.r >= 75)
           SELECT source_id, target_id, {rounded('name_similarity', 6)} AS name_similarity, {rounded('address_similarity', 6)} AS address_similarity, phone_match,
             {rounded('confidence', 6)} AS confidence FROM scored WHERE confidence >= 70
           QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY round(confidence, 9) DESC, target_id) = 1""",
)
def venue_matches(t):
    out = similar.match_venues(t.spark.sql(_SOURCES, supplier=t.supplier), t.spark.sql(_TARGETS, supplier=t.supplier))
    return out.withColumns({c: round_to(F.col(c), 6) for c in ("name_similarity", "address_similarity", "confidence")})


_TWINS = """SELECT a.restaurant_id AS s_id, b.restaurant_id AS t_id, a.lat AS s_lat, a.lng AS s_lng, b.lat + (a.restaurant_id % 9) / 1000.0 AS t_lat, b.lng AS t_lng
    FROM {venues_v} a JOIN {venues_v} b ON b.restaurant_id = a.restaurant_id"""


@query(
    "location_scores",
    "venues_v",
    sql=f"""SELECT s_id, CASE WHEN 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) <= 0.5 THEN 100.0 ELSE 0.0 END::DOUBLE AS location_score FROM (SELECT s_id,
             pow(sin(radians(t_lat - s_lat) / 2), 2) + cos(radians(s_lat)) * cos(radians(t_lat)) * pow(sin(radians(t_lng - s_lng) / 2), 2) AS h
             FROM ({_TWINS.replace('{venues_v}', 'venues_v')}))""",
)
def location_scores(t):
    """Location component of each venue and a copy of it moved by up to 0.9 km."""
    pairs = t.spark.sql(_TWINS, venues_v=t.venues_v)
    return similar.located_score(pairs).select("s_id", "location_score")


@query("dish_fuzzy_lookup", "dictionary_v")
def dish_fuzzy_lookup(t):
    """Every part's whole name looked up in the dictionary with spelling mistakes allowed."""
    asked = t.part.select(F.col("p_name").alias("query"))
    return similar.fuzzy_lookup(asked, dish.lookup_table(dish_dictionary(t)))


@query("dish_mentions_fuzzy", "dictionary_v")
def dish_mentions_fuzzy(t):
    """Dishes in every document, spelling mistakes allowed."""
    texts = t.documents.select(F.col("doc_id").alias("review_id"), "text")
    return similar.fuzzy_mentions(texts, dish.lookup_table(dish_dictionary(t)))
