"""Search and suggestions: lexeme and trigram matching, filters, sorts, pages, top dishes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.geo import haversine_km, within_km
from sofralytics.functions.text import search_key, trigram_similarity, trigrams, without_stopwords
from sofralytics.operators.detail import dish_key

Stemmer = Callable[[Column], Column]


def no_stemming(word: Column) -> Column:
    return word


def light_stemmer(word: Column) -> Column:
    """Plural and case endings, then possessive endings, cut from folded words that stay three letters long."""
    for endings in ("lari|leri|lar|ler|nin|nun|dan|den|tan|ten|da|de|ta|te", "si|su|i|u"):
        cut = F.regexp_replace(word, f"(?:{endings})$", "")
        word = F.when(F.length(cut) >= 3, cut).otherwise(word)
    return word


def lexemes(text: Column, stem: Stemmer = no_stemming) -> Column:
    """Distinct folded, stemmed words without stop words."""
    words = F.array_remove(F.split(search_key(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(without_stopwords(words), stem))


def lexeme_match(query: Column, document: Column) -> Column:
    """Every query lexeme occurs in the document; a query without lexemes matches nothing."""
    return (F.size(query) > 0) & (F.size(F.array_except(query, document)) == 0)


def lexeme_search(queries: DataFrame, documents: DataFrame, stem: Stemmer = no_stemming) -> DataFrame:
    """(query_id, doc_id) pairs for a table of queries, through an inverted index.

    A document must hold all lexemes of a query, so joining on the query's rarest lexeme alone finds every
    match and keeps a word that occurs in a third of the documents out of the join unless a query consists of
    nothing else.
    """
    asked = queries.select("query_id", lexemes(F.col("query"), stem).alias("q"))
    docs = documents.select("doc_id", lexemes(F.col("text"), stem).alias("d"))
    index = docs.select("doc_id", "d", F.explode("d").alias("lexeme"))
    frequency = docs.select(F.explode("d").alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("n"))
    rarest = (
        asked.select("query_id", "q", F.explode("q").alias("lexeme"))
        .join(frequency, "lexeme", "left")
        .groupBy("query_id", "q")
        .agg(F.min_by("lexeme", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("lexeme").alias("l"))).alias("lexeme"))
    )
    return rarest.join(index, "lexeme").filter(lexeme_match(F.col("q"), F.col("d"))).select("query_id", "doc_id")


def similar_names(left: DataFrame, right: DataFrame, threshold: float = fv.TRIGRAM_THRESHOLD) -> DataFrame:
    """(left_id, right_id, similarity) above the threshold, joined on rare shared trigrams.

    Both sides: id, name.  A pair above the threshold shares more than that part of either name's trigrams,
    so with trigrams ordered rarest first the most common ones of each name can stay out of the join without
    losing a pair.  Each pair is emitted once, at its first shared trigram, so no shuffle removes repeats.
    """
    a = left.select(F.col("id").alias("left_id"), trigrams(F.col("name")).alias("t"))
    b = right.select(F.col("id").alias("right_id"), trigrams(F.col("name")).alias("t"))
    every = a.select(F.explode("t").alias("g")).unionByName(b.select(F.explode("t").alias("g")))
    frequency = every.groupBy("g").agg(F.count("*").alias("n"))

    def prefixed(frame: DataFrame, key: str) -> DataFrame:
        ranked = frame.select(key, F.explode("t").alias("g")).join(frequency, "g").groupBy(key).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("t")
        )
        keep = (F.size("t") - F.floor(F.size("t") * threshold)).cast("int")
        return ranked.select(key, "t", F.slice("t", F.lit(1), keep).alias("p"))

    pa = prefixed(a, "left_id").select("left_id", F.col("t").alias("lt"), F.col("p").alias("lp"))
    pb = prefixed(b, "right_id").select("right_id", F.col("t").alias("rt"), F.col("p").alias("rp"))
    # The larger set is at least as large as the shared part, which bounds the similarity from above.
    sizes = F.least(F.size("lt"), F.size("rt")) / F.greatest(F.size("lt"), F.size("rt"))
    pairs = (
        pa.withColumn("g", F.explode("lp"))
        .join(pb.withColumn("g", F.explode("rp")), "g")
        .filter(sizes > threshold)
        .filter(F.array_intersect("lp", "rp")[0] == F.col("g"))
    )
    return pairs.select("left_id", "right_id", trigram_similarity(F.col("lt"), F.col("rt")).alias("similarity")).filter(
        F.col("similarity") > threshold
    )


def self_similar_names(names: DataFrame, threshold: float = fv.TRIGRAM_THRESHOLD) -> DataFrame:
    """(name_a, name_b, similarity) of distinct names with name_a < name_b; copies are reduced first."""
    distinct = names.select("name").distinct().select(F.col("name").alias("id"), "name")
    pairs = similar_names(distinct, distinct, threshold)
    return pairs.filter(F.col("left_id") < F.col("right_id")).select(
        F.col("left_id").alias("name_a"), F.col("right_id").alias("name_b"), "similarity"
    )


def contains_folded(text: Column, query: str | Column) -> Column:
    """Substring match without regard to case or accents."""
    needle = F.lit(query) if isinstance(query, str) else query
    return F.contains(search_key(text), search_key(needle))


@dataclass(frozen=True)
class SearchParams:
    q: str
    district: str | None = None
    cuisine: str | None = None
    price_range: int | None = None
    min_score: float | None = None
    lat: float | None = None
    lng: float | None = None
    sort_by: str = "score"
    page: int = 1
    limit: int = 20


def matches_text(q: str, stem: Stemmer = no_stemming) -> Column:
    """Lexeme match on name and address, or a similar name."""
    document = lexemes(F.concat_ws(" ", "name", F.coalesce("address", F.lit(""))), stem)
    similar = trigram_similarity(trigrams(F.col("name")), trigrams(F.lit(q))) > fv.TRIGRAM_THRESHOLD
    return lexeme_match(lexemes(F.lit(q), stem), document) | similar


def apply_filters(venues: DataFrame, p: SearchParams) -> DataFrame:
    """Cheap, pushable filters; text and distance come after them."""
    rows = venues.filter("is_active")
    if p.district:
        rows = rows.filter(F.lower("district") == p.district.lower())
    if p.cuisine:
        rows = rows.filter(F.array_contains("cuisine_type", p.cuisine))
    if p.price_range:
        rows = rows.filter(F.col("price_range") == p.price_range)
    if p.min_score:
        rows = rows.filter(F.col("overall_score") >= p.min_score)
    if p.lat is not None and p.lng is not None:
        rows = rows.filter(within_km(F.col("lat"), F.col("lng"), p.lat, p.lng, fv.SEARCH_RADIUS_KM))
    return rows


def sort_order(sort_by: str) -> list[Column]:
    """Sort columns of a mode, with the id as last key so pages are stable."""
    modes = {
        "score": [F.col("overall_score").desc_nulls_last()],
        "score_desc": [F.col("overall_score").desc_nulls_last()],
        "distance": [F.col("distance_km").asc_nulls_last()],
        "newest": [F.col("created_at").desc_nulls_first()],
        "reviews_desc": [F.col("total_reviews").desc_nulls_last()],
        "price_asc": [F.col("price_range").asc_nulls_last()],
        "price_desc": [F.col("price_range").desc_nulls_last()],
    }
    if sort_by not in modes:
        raise ValueError(f"unknown sort_by {sort_by}")
    return modes[sort_by] + [F.col("restaurant_id")]


def find(venues: DataFrame, p: SearchParams, stem: Stemmer = no_stemming) -> DataFrame:
    """All matching venues with their distance (NULL without a point)."""
    if p.sort_by == "distance" and (p.lat is None or p.lng is None):
        raise ValueError("sorting by distance needs lat and lng")
    rows = apply_filters(venues, p).filter(matches_text(p.q, stem))
    located = p.lat is not None and p.lng is not None
    km = haversine_km(F.col("lat"), F.col("lng"), F.lit(p.lat), F.lit(p.lng)) if located else F.lit(None).cast("double")
    return rows.withColumn("distance_km", km)


def top_dishes(scores: DataFrame, k: int = fv.TOP_DISHES_PER_VENUE) -> DataFrame:
    """Best k scored dishes of every venue; a group limit runs before the shuffle."""
    order = Window.partitionBy("restaurant_id").orderBy(F.col("score").desc(), "food")
    ranked = scores.filter(F.col("score").isNotNull()).withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= k).select("restaurant_id", "position", "food", "score", "review_count")


def dish_arrays(top: DataFrame) -> DataFrame:
    """The top dishes of a venue as one array of at most k entries."""
    entry = F.struct("position", "food", "score", "review_count")
    return top.groupBy("restaurant_id").agg(F.array_sort(F.collect_list(entry)).alias("top_dishes"))


def paged(found: DataFrame, p: SearchParams) -> DataFrame:
    """One page with the total and page flags; the total is a separate count, not a window over all rows."""
    total = found.agg(F.count("*").alias("n")).scalar()
    rows = found.orderBy(*sort_order(p.sort_by)).offset((p.page - 1) * p.limit).limit(p.limit).withColumn("total", total)
    pages = F.ceil(F.col("total") / float(p.limit)).cast("long")
    return rows.withColumns(
        {"total_pages": pages, "has_next": F.lit(p.page) < pages, "has_prev": F.lit(p.page > 1)}
    )


def search(venues: DataFrame, scores: DataFrame, p: SearchParams, stem: Stemmer = no_stemming) -> DataFrame:
    """A result page with each venue's best dishes.

    Dish scores are cut to the page's venues by a semi join before they are ranked.
    """
    page = paged(find(venues, p, stem), p)
    shown = scores.join(page.select("restaurant_id"), "restaurant_id", "left_semi")
    return page.join(dish_arrays(top_dishes(shown)), "restaurant_id", "left").withColumn(
        "top_dishes", F.coalesce("top_dishes", F.array().cast("array<struct<position:int,food:string,score:double,review_count:bigint>>"))
    )



def suggest_venues(queries: DataFrame, venues: DataFrame, k: int = fv.SUGGESTION_LIMIT, stem: Stemmer = no_stemming) -> DataFrame:
    """Best k active venues per query by similarity, then score (unknown scores first)."""
    active = venues.filter("is_active")
    asked = queries.select(F.col("query_id").alias("id"), F.col("query").alias("name"))
    named = active.select(F.col("restaurant_id").alias("id"), "name")
    similar = similar_names(asked, named).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("restaurant_id"))
    by_word = lexeme_search(queries, active.select(F.col("restaurant_id").alias("doc_id"), F.col("name").alias("text")), stem)
    pairs = similar.unionByName(by_word.withColumnRenamed("doc_id", "restaurant_id")).distinct()
    rows = pairs.join(queries, "query_id").join(active.select("restaurant_id", "name", "overall_score"), "restaurant_id")
    rows = rows.withColumn("similarity", trigram_similarity(trigrams(F.col("name")), trigrams(F.col("query"))))
    order = Window.partitionBy("query_id").orderBy(
        F.col("similarity").desc(), F.col("overall_score").desc_nulls_first(), F.col("restaurant_id")
    )
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select(
        "query_id", "position", "restaurant_id", "name", "similarity", "overall_score"
    )


def dish_venue_counts(dishes: DataFrame, scores: DataFrame) -> DataFrame:
    """Dishes with the number of venues that serve them: one aggregation and a left join, not a lookup per dish."""
    counts = (
        scores.select(search_key(F.col("food")).alias("_k"), "restaurant_id").distinct().groupBy("_k").agg(F.count("*").alias("_n"))
    )
    return (
        dishes.withColumn("_k", dish_key(dishes))
        .join(counts, "_k", "left")
        .withColumn("restaurant_count", F.coalesce("_n", F.lit(0)).cast("long"))
        .drop("_k", "_n")
    )


def suggest_dishes(queries: DataFrame, dishes: DataFrame, scores: DataFrame, k: int = fv.SUGGESTION_LIMIT, stem: Stemmer = no_stemming) -> DataFrame:
    """Best k dishes per query by similarity, each with its number of venues."""
    asked = queries.select(F.col("query_id").alias("id"), F.col("query").alias("name"))
    similar = similar_names(asked, dishes.select(F.col("dish_id").alias("id"), "name"))
    similar = similar.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("dish_id"))
    by_word = lexeme_search(queries, dishes.select(F.col("dish_id").alias("doc_id"), F.col("name").alias("text")), stem)
    pairs = similar.unionByName(by_word.withColumnRenamed("doc_id", "dish_id")).distinct()
    kept = [c for c in ("dish_id", "name", "canonical_name", "category") if c in dishes.columns]
    rows = pairs.join(queries, "query_id").join(dishes.select(*kept), "dish_id")
    rows = rows.withColumn("similarity", trigram_similarity(trigrams(F.col("name")), trigrams(F.col("query"))))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "dish_id")
    best = rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    return dish_venue_counts(best, scores).select(
        "query_id", "position", "dish_id", "name", "category", "similarity", "restaurant_count"
    )
