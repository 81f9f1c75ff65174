"""Search pages, suggestions and name similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.numeric import round_to
from sofralytics.operators import scoring, search
from sofralytics.plans.place_queries import km_sql
from sofralytics.plans.registry import query, rounded, search_key, strings


def venues(t):
    return t.venues_v.withColumn("cuisine_type", F.split("cuisine_tags", ","))


def tri_sql(c: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def sim_sql(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE)"


def lex_sql(c: str) -> str:
    folded = search_key(f"coalesce({c}, '')")
    return (
        f"list_distinct(list_filter(regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda x: NOT list_contains({strings(fv.TURKISH_STOPWORDS)}, x)))"
    )


def _match(q: str) -> str:
    lq = lex_sql(f"'{q}'")
    return (
        f"((len({lq}) > 0 AND len(list_filter({lq}, lambda y: NOT list_contains({lex_sql('concat_ws(' + chr(39) + ' ' + chr(39) + ', name, address)')}, y))) = 0) "
        f"OR {sim_sql(tri_sql('name'), tri_sql(chr(39) + q + chr(39)))} > 0.2)"
    )


def page_sql(p: search.SearchParams, order: str, where: str = "true") -> str:
    km = km_sql("lat", "lng", f"{p.lat}::DOUBLE", f"{p.lng}::DOUBLE") if p.lat is not None else None
    near = f"{km} <= 10.0" if km else "true"
    distance = rounded(km, 6) if km else "NULL::DOUBLE"
    return f""", found AS (SELECT *, {distance} AS distance_km FROM venues_v WHERE is_active AND {where} AND {near} AND {_match(p.q)}),
        total AS (SELECT count(*) AS total FROM found)
        SELECT restaurant_id, name, CAST(overall_score AS DOUBLE) AS overall_score, distance_km, total, CAST(ceil(total / {float(p.limit)}) AS BIGINT) AS total_pages,
          {p.page} < ceil(total / {float(p.limit)}) AS has_next, {p.page} > 1 AS has_prev
        FROM found, total ORDER BY {order}, restaurant_id LIMIT {p.limit} OFFSET {(p.page - 1) * p.limit}"""


def _page(t, p):
    out = search.paged(search.find(venues(t), p), p)
    return out.select(
        "restaurant_id", "name", F.col("overall_score").cast("double").alias("overall_score"),
        round_to(F.col("distance_km"), 6).alias("distance_km"), "total", "total_pages", "has_next", "has_prev",
    )


BY_SCORE = search.SearchParams("supplier street", page=2, limit=10)
BY_DISTANCE = search.SearchParams("supplier", lat=41.0, lng=28.9, sort_by="distance")
BY_NEWEST = search.SearchParams("supplier", cuisine="turk", price_range=1, min_score=3.0, sort_by="newest")
IN_DISTRICT = search.SearchParams("nation_3", district="NATION_3", sort_by="price_desc")


@query("search_by_score", "venues_v", sql=page_sql(BY_SCORE, "overall_score DESC NULLS LAST"))
def search_by_score(t):
    return _page(t, BY_SCORE)


@query("search_by_distance", "venues_v", sql=page_sql(BY_DISTANCE, km_sql("lat", "lng", "41.0::DOUBLE", "28.9::DOUBLE")))
def search_by_distance(t):
    return _page(t, BY_DISTANCE)


@query(
    "search_by_newest",
    "venues_v",
    sql=page_sql(BY_NEWEST, "created_at DESC NULLS FIRST", "list_contains(string_split(cuisine_tags, ','), 'turk') AND price_range = 1 AND overall_score >= 3.0"),
)
def search_by_newest(t):
    return _page(t, BY_NEWEST)


@query("search_in_district", "venues_v", sql=page_sql(IN_DISTRICT, "price_range DESC NULLS LAST", "lower(district) = 'nation_3'"))
def search_in_district(t):
    return _page(t, IN_DISTRICT)


@query(
    "venue_filter_counts",
    "venues_v",
    sql="""SELECT count(*) AS all_rows, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE lower(district) = 'nation_5') AS in_district,
           count(*) FILTER (WHERE list_contains(string_split(cuisine_tags, ','), 'kebap')) AS kebap, count(*) FILTER (WHERE price_range = 2) AS price_two,
           count(*) FILTER (WHERE overall_score >= 7.5) AS good FROM venues_v""",
)
def venue_filter_counts(t):
    return venues(t).agg(
        F.count("*").alias("all_rows"), F.count_if("is_active").alias("active"), F.count_if(F.lower("district") == "nation_5").alias("in_district"),
        F.count_if(F.array_contains("cuisine_type", "kebap")).alias("kebap"), F.count_if(F.col("price_range") == 2).alias("price_two"),
        F.count_if(F.col("overall_score") >= 7.5).alias("good"),
    )


@query("substring_search", sql=f"SELECT doc_id FROM documents WHERE contains({search_key('text')}, 'und ver')")
def substring_search(t):
    return t.documents.filter(search.contains_folded(F.col("text"), "ünd Ver")).select("doc_id")


def _sorted_sql(order: str) -> str:
    return f"SELECT restaurant_id, row_number() OVER (ORDER BY {order}, restaurant_id) AS position FROM venues_v WHERE is_active ORDER BY position LIMIT 15"


def _sorted(t, mode):
    from pyspark.sql.window import Window

    top = t.venues_v.filter("is_active").orderBy(*search.sort_order(mode)).limit(15)
    # Only the page itself is numbered.
    return top.select("restaurant_id", F.row_number().over(Window.orderBy(*search.sort_order(mode))).cast("long").alias("position"))


@query("sort_by_reviews", "venues_v", sql=_sorted_sql("total_reviews DESC"))
def sort_by_reviews(t):
    return _sorted(t, "reviews_desc")


@query("sort_by_price_up", "venues_v", sql=_sorted_sql("price_range"))
def sort_by_price_up(t):
    return _sorted(t, "price_asc")


@query("sort_by_price_down", "venues_v", sql=_sorted_sql("price_range DESC"))
def sort_by_price_down(t):
    return _sorted(t, "price_desc")


@query("sort_by_score", "venues_v", sql=_sorted_sql("overall_score DESC NULLS LAST"))
def sort_by_score(t):
    return _sorted(t, "score_desc")


@query(
    "name_similarity",
    sql=f"""WITH names AS (SELECT name, {tri_sql('name')} AS g FROM (SELECT DISTINCT concat(p_name, ' ', p_type) AS name FROM part)),
           pairs AS (SELECT a.name AS name_a, b.name AS name_b, {sim_sql('a.g', 'b.g')} AS s FROM names a JOIN names b ON a.name < b.name)
           SELECT name_a, name_b, {rounded('s', 6)} AS similarity FROM pairs WHERE s > 0.2""",
)
def name_similarity(t):
    pairs = search.self_similar_names(t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name")))
    return pairs.withColumn("similarity", round_to(F.col("similarity"), 6))


_QUERIES = """SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE n_nationkey % 5 WHEN 0 THEN concat('supplier 00000000', CAST(n_nationkey AS STRING))
    WHEN 1 THEN 'blue ring' WHEN 2 THEN 'red  wdget' WHEN 3 THEN 'Small Bolt' ELSE n_name END AS query FROM {nation}"""
_QSQL = f"queries AS ({_QUERIES.replace('{nation}', 'nation')})"


def _queries(t):
    return t.spark.sql(_QUERIES, nation=t.nation)


@query(
    "lexeme_search",
    "venues_v",
    sql=f""", {_QSQL}, q AS (SELECT query_id, {lex_sql("CASE WHEN query_id % 5 = 4 THEN query ELSE concat('street ', CAST(query_id % 13 AS VARCHAR), ' no') END")} AS l FROM queries),
           d AS (SELECT restaurant_id, {lex_sql("concat_ws(' ', name, address)")} AS l FROM venues_v)
           SELECT query_id, restaurant_id AS doc_id FROM q, d WHERE len(q.l) > 0 AND len(list_filter(q.l, lambda x: NOT list_contains(d.l, x))) = 0""",
)
def lexeme_search(t):
    text = F.when(F.col("query_id") % 5 == 4, F.col("query")).otherwise(F.concat(F.lit("street "), (F.col("query_id") % 13).cast("string"), F.lit(" no")))
    docs = t.venues_v.select(F.col("restaurant_id").alias("doc_id"), F.concat_ws(" ", "name", "address").alias("text"))
    return search.lexeme_search(_queries(t).withColumn("query", text), docs)


@query("lexeme_search_stemmed", "venues_v")
def lexeme_search_stemmed(t):
    docs = t.venues_v.select(F.col("restaurant_id").alias("doc_id"), F.concat_ws(" ", "name", "address").alias("text"))
    return search.lexeme_search(_queries(t).withColumn("query", F.lit("streetler")), docs, search.light_stemmer)


@query(
    "suggest_venues",
    "venues_v",
    sql=f""", {_QSQL}, pairs AS (SELECT query_id, restaurant_id, name, overall_score, {sim_sql(tri_sql('name'), tri_sql('query'))} AS s,
             len({lex_sql('query')}) > 0 AND len(list_filter({lex_sql('query')}, lambda x: NOT list_contains({lex_sql('name')}, x))) = 0 AS hit
             FROM queries, venues_v WHERE is_active)
           SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, overall_score DESC NULLS FIRST, restaurant_id) AS INT) AS position,
             restaurant_id, name, {rounded('s', 6)} AS similarity, CAST(overall_score AS DOUBLE) AS overall_score
           FROM pairs WHERE s > 0.2 OR hit QUALIFY position <= 5""",
)
def suggest_venues(t):
    out = search.suggest_venues(_queries(t), t.venues_v)
    return out.withColumns({"similarity": round_to(F.col("similarity"), 6), "overall_score": F.col("overall_score").cast("double")})


@query(
    "suggest_dishes",
    "dishes_v",
    "scores_v",
    sql=f""", {_QSQL}, counts AS (SELECT food, count(DISTINCT restaurant_id) AS n FROM scores_v GROUP BY food),
           pairs AS (SELECT query_id, dish_id, name, category, {sim_sql(tri_sql('name'), tri_sql('query'))} AS s,
             len({lex_sql('query')}) > 0 AND len(list_filter({lex_sql('query')}, lambda x: NOT list_contains({lex_sql('name')}, x))) = 0 AS hit FROM queries, dishes_v)
           SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, dish_id) AS INT) AS position, dish_id, name, category,
             {rounded('s', 6)} AS similarity, coalesce(n, 0) AS restaurant_count
           FROM pairs LEFT JOIN counts ON food = name WHERE s > 0.2 OR hit QUALIFY position <= 5""",
)
def suggest_dishes(t):
    scores = scoring.dish_sums(t.mentions_v).select("restaurant_id", "food")
    out = search.suggest_dishes(_queries(t), t.dishes_v, scores)
    return out.withColumn("similarity", round_to(F.col("similarity"), 6))


@query(
    "dish_venue_counts",
    "dishes_v",
    "scores_v",
    sql="""SELECT dish_id, name, coalesce(n, 0) AS restaurant_count FROM dishes_v
           LEFT JOIN (SELECT food, count(DISTINCT restaurant_id) AS n FROM scores_v GROUP BY food) ON food = name""",
)
def dish_venue_counts(t):
    scores = scoring.dish_sums(t.mentions_v).select("restaurant_id", "food")
    return search.dish_venue_counts(t.dishes_v, scores).select("dish_id", "name", "restaurant_count")


@query(
    "top_dishes_per_venue",
    "scores_v",
    sql="""SELECT restaurant_id, CAST(row_number() OVER (PARTITION BY restaurant_id ORDER BY score DESC, food) AS INT) AS position, food, score, review_count
           FROM scores_v WHERE score IS NOT NULL QUALIFY position <= 3""",
)
def top_dishes_per_venue(t):
    return search.top_dishes(scoring.score_dishes(t.mentions_v))


@query(
    "search_with_dishes",
    "venues_v",
    "scores_v",
    sql=page_sql(BY_SCORE, "overall_score DESC NULLS LAST").replace("SELECT restaurant_id, name,", "SELECT * FROM (SELECT restaurant_id, name,", 1)
    + """) LEFT JOIN (SELECT restaurant_id, array_to_string(array_agg(food ORDER BY score DESC, food), '|') AS dishes FROM
           (SELECT * FROM scores_v QUALIFY row_number() OVER (PARTITION BY restaurant_id ORDER BY score DESC, food) <= 3) GROUP BY restaurant_id) USING (restaurant_id)""",
)
def search_with_dishes(t):
    out = search.search(venues(t), scoring.score_dishes(t.mentions_v), BY_SCORE)
    dishes = F.when(F.size("top_dishes") > 0, F.array_join(F.transform("top_dishes", lambda d: d["food"]), "|"))
    return out.select(
        "restaurant_id", "name", F.col("overall_score").cast("double").alias("overall_score"), "distance_km", "total", "total_pages",
        "has_next", "has_prev", dishes.alias("dishes"),
    )
