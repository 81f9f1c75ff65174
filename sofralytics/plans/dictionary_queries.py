"""Dish dictionary, extraction over whole documents, item classes and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.functions import fixed_values as fv
from sofralytics.operators import dictionary as dish
from sofralytics.plans.registry import query, rounded, strings
from sofralytics.plans.text_queries import NORMALIZE, TOKENS


def dish_dictionary(t):
    return t.dictionary_v.select("load_position", "canonical", F.array("alias_1", "alias_2").alias("aliases"), "category", "region")


def documents_as_reviews(t):
    return t.documents.select(F.col("doc_id").alias("review_id"), "text", F.lit(3).alias("star_rating"))


_N = NORMALIZE.format(c="name")
LOOKUP = f"""lookup AS (SELECT key, arg_max(canonical, ord) AS canonical FROM (
    SELECT canonical, load_position * 100 + no * 10 + form AS ord,
           CASE form WHEN 0 THEN k ELSE translate(k, 'çğıöşü', 'cgiosu') END AS key
    FROM (SELECT canonical, load_position, no, {_N} AS k FROM (
            SELECT canonical, load_position, 0 AS no, canonical AS name FROM dictionary_v
            UNION ALL SELECT canonical, load_position, 1, alias_1 FROM dictionary_v
            UNION ALL SELECT canonical, load_position, 2, alias_2 FROM dictionary_v)), (VALUES (0), (1)) f(form))
    WHERE key <> '' GROUP BY key)"""
EXACT = f"""{LOOKUP},
    toks AS (SELECT doc_id AS review_id, {TOKENS} AS w FROM documents),
    runs AS (
      SELECT review_id, 1 AS n, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM toks
      UNION ALL SELECT review_id, 2, w[i] || ' ' || w[i+1], i FROM (SELECT review_id, w, unnest(range(1, len(w))) AS i FROM toks)
      UNION ALL SELECT review_id, 3, w[i] || ' ' || w[i+1] || ' ' || w[i+2], i FROM (SELECT review_id, w, unnest(range(1, len(w) - 1)) AS i FROM toks)
      UNION ALL SELECT review_id, 4, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3], i
        FROM (SELECT review_id, w, unnest(range(1, len(w) - 2)) AS i FROM toks)),
    exact AS (SELECT review_id, l.canonical, c AS matched_text, 100.0::DOUBLE AS score FROM runs JOIN lookup l ON l.key = runs.c
      QUALIFY row_number() OVER (PARTITION BY review_id, l.canonical ORDER BY length(c) DESC, n, i) = 1)"""
_SQUEEZE = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def _class_sql(item: str) -> str:
    drinks, sides = dish._longest_first(fv.BEVERAGE_KEYWORDS), dish._longest_first(fv.SIDE_ITEM_KEYWORDS)
    return f"""SELECT *, CASE WHEN side IS NOT NULL THEN 'yan_urun' WHEN drink IS NOT NULL AND NOT over THEN 'icecek' ELSE 'yemek' END AS type,
        CASE WHEN side IS NOT NULL THEN side WHEN drink IS NOT NULL AND NOT over THEN drink END AS class_category,
        CASE WHEN side IS NOT NULL THEN 0.95 WHEN drink IS NOT NULL AND NOT over THEN 0.9 WHEN drink IS NOT NULL THEN 0.7 ELSE 0.6 END::DOUBLE AS class_confidence
      FROM (SELECT *, NOT contains(drink, ' ') AND (len(string_split(nm, ' ')) >= 3
               OR len(list_filter({strings(fv.FOOD_OVERRIDE_TERMS)}, lambda x: contains(nm, x))) > 0) AS over
      FROM (SELECT *, list_filter({strings(sides)}, lambda x: contains(nm, x))[1] AS side,
                   list_filter({strings(drinks)}, lambda x: contains(nm, x))[1] AS drink
      FROM (SELECT *, {_SQUEEZE.format(c=item)} AS nm FROM {{source}})))"""


EXTRACTED = EXACT + f""",
    attrs AS (SELECT canonical, arg_min(category, load_position) AS category, arg_min(region, load_position) AS region FROM dictionary_v GROUP BY canonical),
    classed AS ({_class_sql('canonical').replace('{source}', 'attrs')}),
    extracted AS (SELECT e.*, c.region, c.type AS item_type, c.type = 'yemek' AS is_food,
        CASE WHEN c.type = 'yemek' THEN c.category ELSE c.type END AS category FROM exact e LEFT JOIN classed c USING (canonical))"""


def extracted(t):
    entries = dish_dictionary(t)
    return dish.extracted_dishes(dish.exact_mentions(documents_as_reviews(t), dish.lookup_table(entries)), entries)


@query("dish_lookup", "dictionary_v", sql=f", {LOOKUP} SELECT * FROM lookup")
def dish_lookup(t):
    return dish.lookup_table(dish_dictionary(t)).select("key", "canonical")


@query(
    "dish_exact_match",
    "dictionary_v",
    sql=f""", {LOOKUP} SELECT conv_id, turn, position, l.canonical FROM
           (SELECT conv_id, turn, position, {NORMALIZE.format(c="concat(p[position], ' ', coalesce(p[position + 1], ''))")} AS key FROM
             (SELECT conv_id, turn, p, unnest(range(1, greatest(len(p), 2))) AS position FROM
               (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS p FROM conversations)))
           LEFT JOIN lookup l USING (key)""",
)
def dish_exact_match(t):
    """Every two words in a row of every message looked up as a dish name."""
    parts = F.split(F.coalesce("text", F.lit("")), " ")
    messages = t.conversations.select("conv_id", "turn", parts.alias("p"))
    placed = messages.select("conv_id", "turn", "p", F.explode(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1)))).alias("position"))
    pair = F.concat(F.get("p", F.col("position") - 1), F.lit(" "), F.coalesce(F.get("p", F.col("position")), F.lit("")))
    asked = placed.select("conv_id", "turn", F.col("position").cast("long").alias("position"), pair.alias("query"))
    return dish.exact_match(asked, dish.lookup_table(dish_dictionary(t))).select("conv_id", "turn", "position", "canonical")


@query("dish_mentions_exact", "dictionary_v", sql=f", {EXACT} SELECT review_id, canonical, matched_text, score FROM exact")
def dish_mentions_exact(t):
    found = dish.exact_mentions(documents_as_reviews(t), dish.lookup_table(dish_dictionary(t)))
    return found.select("review_id", "canonical", "matched_text", "score")


_ITEMS = """(SELECT p_partkey AS item_id, CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ' çay') WHEN 1 THEN concat('Filtre  Kahve ', p_brand)
    WHEN 2 THEN concat('çay yaprağı ', p_name) WHEN 3 THEN 'peçete' WHEN 4 THEN 'Portakal suyu' WHEN 5 THEN 'ayran'
    WHEN 6 THEN concat(p_name, ' Kebap su') WHEN 7 THEN 'taze sıkılmış portakal suyu' ELSE p_name END AS item, p_size FROM {part})"""


def _items(t):
    return t.spark.sql("SELECT * FROM " + _ITEMS, part=t.part)


@query(
    "item_class",
    sql=f"""SELECT item_id, type, class_category AS category, class_confidence AS confidence,
            type = 'icecek' OR (side IS NOT NULL AND drink IS NOT NULL AND NOT over) AS is_beverage, side IS NOT NULL AS is_side_item
            FROM ({_class_sql('item').replace('{source}', _ITEMS.replace('{part}', 'part'))})""",
)
def item_class(t):
    item = F.col("item")
    return _items(t).select(
        "item_id", dish.classify_item(item).alias("c"), dish.is_beverage(item).alias("is_beverage"), dish.is_side_item(item).alias("is_side_item")
    ).select("item_id", "c.type", "c.category", "c.confidence", "is_beverage", "is_side_item")


@query(
    "menu_bucket_counts",
    sql=f"""SELECT p_size AS menu, count(*) FILTER (WHERE type = 'yemek') AS foods, count(*) FILTER (WHERE type = 'icecek') AS beverages,
            count(*) FILTER (WHERE type = 'yan_urun') AS side_items FROM ({_class_sql('item').replace('{source}', _ITEMS.replace('{part}', 'part'))}) GROUP BY p_size""",
)
def menu_bucket_counts(t):
    rows = _items(t).select("p_size", dish.classify_item(F.col("item"))["type"].alias("type"))
    return rows.groupBy(F.col("p_size").alias("menu")).agg(
        F.count_if(F.col("type") == fv.ITEM_FOOD).alias("foods"), F.count_if(F.col("type") == fv.ITEM_BEVERAGE).alias("beverages"),
        F.count_if(F.col("type") == fv.ITEM_SIDE).alias("side_items"),
    )


@query(
    "menu_buckets",
    sql=f"""SELECT item_id, CASE WHEN type = 'yemek' THEN item ELSE '' END AS foods, CASE WHEN type = 'icecek' THEN item ELSE '' END AS beverages,
            CASE WHEN type = 'yan_urun' THEN item ELSE '' END AS side_items FROM ({_class_sql('item').replace('{source}', _ITEMS.replace('{part}', 'part'))})""",
)
def menu_buckets(t):
    menus = _items(t).select("item_id", F.array("item").alias("items"))
    out = dish.menu_buckets(menus)
    return out.select("item_id", *[F.array_join(c, "|").alias(c) for c in ("foods", "beverages", "side_items")])


@query(
    "extracted_dishes",
    "dictionary_v",
    sql=f", {EXTRACTED} SELECT review_id, canonical, matched_text, score, category, region, is_food FROM extracted",
)
def extracted_dishes(t):
    return extracted(t).select("review_id", "canonical", "matched_text", "score", "category", "region", "is_food")


_FOODS = EXTRACTED + """, foods AS (SELECT review_id, count(*) FILTER (WHERE is_food) AS food_count,
    array_agg({'canonical': canonical, 'matched_text': matched_text, 'score': score, 'category': category, 'is_food': is_food}
      ORDER BY score DESC, length(matched_text) DESC, canonical) AS foods FROM extracted GROUP BY review_id)"""


@query(
    "review_dishes",
    "dictionary_v",
    sql=f""", {_FOODS} SELECT doc_id AS review_id, coalesce(food_count, 0) AS food_count,
            coalesce(array_to_string(list_transform(foods, lambda f: f.canonical), '|'), '') AS dishes
            FROM documents LEFT JOIN foods ON doc_id = review_id""",
)
def review_dishes(t):
    rows = dish.review_dishes(documents_as_reviews(t), extracted(t))
    return rows.select("review_id", "food_count", F.array_join(F.transform("foods", lambda f: f["canonical"]), "|").alias("dishes"))


@query(
    "review_foods_json",
    "dictionary_v",
    sql=f""", {_FOODS} SELECT doc_id AS review_id, coalesce(food_count, 0) AS food_count,
            coalesce(CAST(to_json(foods) AS VARCHAR), '[]') AS foods_json FROM documents LEFT JOIN foods ON doc_id = review_id""",
)
def review_foods_json(t):
    return dish.foods_json(dish.review_dishes(documents_as_reviews(t), extracted(t))).select("review_id", "food_count", "foods_json")


@query(
    "top_dishes",
    "dictionary_v",
    sql=f", {EXTRACTED} SELECT canonical AS food, count(*) AS n FROM extracted WHERE is_food GROUP BY 1 ORDER BY n DESC, food LIMIT 20",
)
def top_dishes(t):
    return dish.top_dishes(extracted(t))


@query(
    "dish_category_distribution",
    "dictionary_v",
    sql=f", {EXTRACTED} SELECT coalesce(category, 'bilinmeyen') AS category, count(*) AS n FROM extracted GROUP BY 1",
)
def dish_category_distribution(t):
    return dish.category_distribution(extracted(t))


@query(
    "corpus_dish_totals",
    "dictionary_v",
    sql=f""", {EXTRACTED} SELECT count(*) FILTER (WHERE is_food) AS total_food_mentions, count(DISTINCT canonical) FILTER (WHERE is_food) AS total_unique_foods,
            (SELECT count(*) FROM documents) AS total_reviews,
            {rounded("count(*) FILTER (WHERE is_food) / CAST((SELECT count(*) FROM documents) AS DOUBLE)", 2)} AS average_food_per_review FROM extracted""",
)
def corpus_dish_totals(t):
    return dish.corpus_totals(t.documents, extracted(t))
