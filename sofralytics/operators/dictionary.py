"""Dish dictionary look-up, extraction of dish names from review text, and item classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.numeric import round_to
from sofralytics.functions.text import ascii_fold, contains_any, first_contained, normalize, squeeze_lower, tokens
from sofralytics.operators.sizing import bounded, spread

MAX_WORDS = 4
PLACE_BITS = 40  # a position as one number: the words in a run above these bits, the first word below


def lookup_table(dictionary: DataFrame) -> DataFrame:
    """key -> canonical for canonical names and aliases, each as written and ASCII-folded.

    ``dictionary``: canonical, aliases, category, region, load_position.  On a clash the later row wins;
    ``key_order`` is where the key was first met.
    """
    names = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = dictionary.filter(F.coalesce("canonical", F.lit("")) != "").select(
        "canonical", "load_position", F.posexplode(names).alias("name_no", "name")
    )
    raw = normalize(F.col("name"))
    keys = rows.select(
        "canonical", "load_position", "name_no", F.posexplode(F.array(raw, ascii_fold(raw))).alias("form_no", "key")
    ).filter(F.col("key") != "")
    return keys.groupBy("key").agg(
        F.max_by("canonical", F.struct("load_position", "name_no", "form_no")).alias("canonical"),
        F.min(F.struct("load_position", "name_no", "form_no")).alias("key_order"),
    )


def dish_attributes(dictionary: DataFrame) -> DataFrame:
    """Category and region of each canonical name, taken from its first row."""
    return dictionary.groupBy("canonical").agg(
        F.min_by("category", "load_position").alias("category"), F.min_by("region", "load_position").alias("region")
    )


def exact_match(queries: DataFrame, lookup: DataFrame, column: str = "query") -> DataFrame:
    """Queries with the canonical dish whose key equals the normalised query, NULL when none does."""
    keyed = queries.withColumn("key", normalize(F.col(column)))
    return keyed.join(bounded(lookup.select("key", "canonical")), "key", "left").drop("key")


def _key_form(run: Column) -> Column:
    """Tokens are lower-cased words already; only an underscore still needs normalising."""
    return F.when(F.contains(run, F.lit("_")), normalize(run)).otherwise(run)


def word_windows(reviews: DataFrame) -> DataFrame:
    """(review_id, start, run): the up to four words that begin at every word of the text."""
    rows = spread(reviews.select("review_id", "text")).select("review_id", tokens(F.col("text")).alias("w"))
    # Word by word, since a slice copies the whole array first; past the end there is null, which is left out.
    runs = F.transform(F.col("w"), lambda word, i: F.concat_ws(" ", word, *[F.get(F.col("w"), i + k) for k in range(1, MAX_WORDS)]))
    return rows.select("review_id", F.posexplode(runs).alias("start", "run"))


def candidates(reviews: DataFrame) -> DataFrame:
    """(review_id, position, candidate, key): every run of one to four words.

    ``position`` orders single words first, then pairs and so on, each in reading order.
    """
    words = F.split("run", " ")
    rows = word_windows(reviews).select("review_id", "start", "run", F.explode(F.sequence(F.lit(1), F.size(words))).alias("n"))
    rows = rows.withColumn("candidate", F.call_function("substring_index", F.col("run"), F.lit(" "), F.col("n")))
    return rows.select("review_id", F.struct("n", "start").alias("position"), "candidate", _key_form(F.col("candidate")).alias("key"))


def best_per_dish(matches: DataFrame) -> DataFrame:
    """One row per (review, canonical): highest score, then longest text, then earliest position."""
    earliest = F.struct((-F.col("position.n")).alias("n"), (-F.col("position.start")).alias("s"))
    rank = F.struct(F.col("score"), F.length("matched_text").alias("l"), earliest.alias("p"))
    best = F.max_by(F.struct("matched_text", "score", "method"), rank)
    return matches.groupBy("review_id", "canonical").agg(best.alias("b")).select(
        "review_id", "canonical", "b.matched_text", "b.score", "b.method"
    )


def word_places(reviews: DataFrame) -> DataFrame:
    """(review_id, start, spaced, w0 .. w3, m0 .. m3): every word of the text and the three after it, not joined to a string.

    Where the text holds an underscore (``spaced``), which is part of a word but a space in a key, ``m0`` .. ``m3`` are
    the same words in the form of keys, null where nothing is left.
    """
    underscore, none = F.contains("text", F.lit("_")), F.array().cast("array<string>")
    rows = spread(reviews.select("review_id", "text")).select("review_id", underscore.alias("spaced"), tokens(F.col("text")).alias("w"))
    rows = rows.withColumn("m", F.when(F.col("spaced"), F.transform("w", lambda word: F.nullif(normalize(word), F.lit("")))).otherwise(none))
    # The words shifted once a text, so that no lambda runs and no array is copied for each word.
    names = [f"{c}{k}" for c in "wm" for k in range(MAX_WORDS)]
    rows = rows.select("review_id", "spaced", *[F.slice(name[0], F.lit(int(name[1]) + 1), F.size(name[0])).alias(name) for name in names])
    return rows.select("review_id", "spaced", F.posexplode(F.arrays_zip(*names)).alias("start", "at")).select("review_id", "spaced", "start", *[F.col(f"at.{name}") for name in names])


def exact_mentions(reviews: DataFrame, lookup: DataFrame) -> DataFrame:
    """Dishes named literally in each review, best match per dish.

    Every word of the text is joined to the keys that start with it, and the words after it are compared
    with the key's in the join condition, so no run of words is built unless the text holds an underscore.
    Only matched rows reach the shuffle on review and dish.  No lambda runs on words, so that they, the join
    and the first aggregation are one compiled stage; its code must stay under the 8,000 bytes a method
    that the JVM compiles (a test holds it there).
    """
    first_word = lambda c: F.call_function("substring_index", c, F.lit(" "), F.lit(1))
    of_key = F.split("key", " ")
    keys = lookup.select("key", "canonical", first_word(F.col("key")).alias("first"), F.size(of_key).alias("key_words"), *[F.get(of_key, F.lit(k)).alias(f"k{k}") for k in range(1, MAX_WORDS)])
    words, forms, key = [F.col(f"w{k}") for k in range(MAX_WORDS)], [F.col(f"m{k}") for k in range(MAX_WORDS)], F.col("key")
    run = F.concat_ws(" ", *words)
    odd = F.col("spaced") & F.contains(run, F.lit("_"))
    runs = word_places(reviews).withColumn("first", F.when(odd, first_word(F.concat_ws(" ", *forms))).otherwise(F.col("w0")))
    # A run with an underscore may use more or fewer tokens than the key has words; take the longest.
    odd_length = F.coalesce(*[F.when(words[n - 1].isNotNull() & (F.concat_ws(" ", *forms[:n]) == key), n) for n in range(MAX_WORDS, 0, -1)])
    same = F.col("key_words") <= MAX_WORDS
    for k in range(1, MAX_WORDS):
        same &= F.col(f"k{k}").isNull() | F.coalesce(F.col(f"k{k}") == words[k], F.lit(False))
    hits = runs.join(bounded(keys), "first").withColumn("n", F.when(odd, odd_length).when(same, F.col("key_words"))).filter("n IS NOT NULL")
    text = F.when(odd, F.call_function("substring_index", run, F.lit(" "), F.col("n"))).otherwise(key)
    # Repeats of a text in a review are reduced to the earliest first: the position as one number keeps this a hash aggregation.
    place = F.shiftleft(F.col("n").cast("long"), PLACE_BITS) + F.col("start")
    earliest = hits.select("review_id", "canonical", text.alias("matched_text"), place.alias("place")).groupBy("review_id", "canonical", "matched_text")
    earliest = earliest.agg(F.min("place").alias("place"))
    start = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))
    return best_per_dish(
        earliest.select(
            "review_id", "canonical", F.struct(F.shiftright("place", PLACE_BITS).cast("int").alias("n"), start.cast("int").alias("start")).alias("position"),
            "matched_text", F.lit(100.0).alias("score"), F.lit("exact").alias("method"),
        )
    )


def _longest_first(keywords) -> list[str]:
    return sorted((k.strip().lower() for k in keywords), key=len, reverse=True)


def _once(value: Column, body) -> Column:
    """``body`` of the value, which is bound to a lambda variable and so computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _overridden(name: Column, drink: Column) -> Column:
    single = ~F.contains(drink, F.lit(" "))
    return single & ((F.size(F.split(name, " ")) >= 3) | contains_any(name, fv.FOOD_OVERRIDE_TERMS))


def classify_item(item: Column, beverages=fv.BEVERAGE_KEYWORDS, sides=fv.SIDE_ITEM_KEYWORDS) -> Column:
    """Struct (type, category, confidence): side item, beverage, or food."""

    def made(kind, category, confidence):
        return F.struct(F.lit(kind).alias("type"), category.cast("string").alias("category"), F.lit(confidence).alias("confidence"))

    nothing = F.lit(None)

    def drink_or_food(name, drink):
        food = F.when(drink.isNull(), made(fv.ITEM_FOOD, nothing, 0.6))
        return food.when(_overridden(name, drink), made(fv.ITEM_FOOD, nothing, 0.7)).otherwise(made(fv.ITEM_BEVERAGE, drink, 0.9))

    def kind(name):
        other = _once(first_contained(name, _longest_first(beverages)), lambda drink: drink_or_food(name, drink))
        return _once(first_contained(name, _longest_first(sides)), lambda side: F.when(side.isNotNull(), made(fv.ITEM_SIDE, side, 0.95)).otherwise(other))

    return _once(squeeze_lower(item), kind)


def is_beverage(item: Column, beverages=fv.BEVERAGE_KEYWORDS) -> Column:
    found = lambda name, drink: drink.isNotNull() & ~_overridden(name, drink)
    return _once(squeeze_lower(item), lambda name: _once(first_contained(name, _longest_first(beverages)), lambda drink: F.coalesce(found(name, drink), F.lit(False))))


def is_side_item(item: Column, sides=fv.SIDE_ITEM_KEYWORDS) -> Column:
    return _once(squeeze_lower(item), lambda name: first_contained(name, _longest_first(sides)).isNotNull())


def menu_buckets(menus: DataFrame, items: str = "items") -> DataFrame:
    """Each menu's item array split into foods, beverages, side items and (always empty) unknown."""
    typed = F.transform(F.col(items), lambda i: F.struct(i.alias("item"), classify_item(i)["type"].alias("type")))
    pick = lambda kinds, kind: F.transform(F.filter(kinds, lambda s: s["type"] == kind), lambda s: s["item"])
    names = {"foods": fv.ITEM_FOOD, "beverages": fv.ITEM_BEVERAGE, "side_items": fv.ITEM_SIDE}
    # One value with all buckets, so that no bucket makes the plan classify the items again.
    split = _once(typed, lambda kinds: F.struct(*[pick(kinds, kind).alias(name) for name, kind in names.items()]))
    rows = spread(menus).withColumn("_k", split)
    return rows.withColumns({**{name: F.col("_k")[name] for name in names}, "unknown": F.array().cast("array<string>")}).drop("_k")


def extracted_dishes(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Matches with region, item class and category (the item type for anything that is not food)."""
    attributes = dish_attributes(dictionary)
    classes = attributes.withColumn("_c", classify_item(F.col("canonical"))).select(
        "canonical", F.col("category").alias("_category"), "region", F.col("_c.type").alias("item_type")
    )
    is_food = F.col("item_type") == fv.ITEM_FOOD
    return (
        mentions.join(bounded(classes), "canonical", "left")
        .withColumn("is_food", is_food)
        .withColumn("category", F.when(is_food, F.col("_category")).otherwise(F.col("item_type")))
        .drop("_category")
    )


def review_dishes(reviews: DataFrame, extracted: DataFrame) -> DataFrame:
    """Every review with its dish array and food count.

    A review's array holds one entry per dictionary dish at most, however often the dish is named.
    """
    entry = F.struct("canonical", "matched_text", "score", "category", "is_food")
    longest_first = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("o1"), (-F.length("matched_text")).alias("o2"), F.col("canonical").alias("o3"), entry.alias("e")))
    )
    foods = extracted.groupBy("review_id").agg(
        F.transform(longest_first, lambda x: x["e"]).alias("foods"), F.count_if("is_food").alias("food_count")
    )
    return (
        reviews.select("review_id", "star_rating")
        .join(foods, "review_id", "left")
        .select(
            "review_id", "star_rating",
            F.coalesce("foods", F.array().cast("array<struct<canonical:string,matched_text:string,score:double,category:string,is_food:boolean>>")).alias("foods"),
            F.coalesce("food_count", F.lit(0)).cast("long").alias("food_count"),
        )
    )


def foods_json(review_rows: DataFrame) -> DataFrame:
    return review_rows.select("review_id", "star_rating", F.to_json("foods").alias("foods_json"), "food_count")


def top_dishes(extracted: DataFrame, k: int = 20) -> DataFrame:
    """The k most mentioned dishes."""
    counts = extracted.filter("is_food").groupBy(F.col("canonical").alias("food")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "food").limit(k)


def category_distribution(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy(F.coalesce("category", F.lit("bilinmeyen")).alias("category")).agg(F.count("*").alias("n"))


def corpus_totals(review_count: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: reviews, dish mentions, distinct dishes, mean dishes per review."""
    foods = extracted.filter("is_food")
    totals = foods.agg(F.count("*").alias("total_food_mentions"), F.countDistinct("canonical").alias("total_unique_foods"))
    reviews = review_count.agg(F.count("*").alias("n")).scalar()
    return totals.withColumn("total_reviews", reviews).withColumn(
        "average_food_per_review",
        F.when(F.col("total_reviews") > 0, round_to(F.col("total_food_mentions") / F.col("total_reviews"), 2)).otherwise(F.lit(0.0)),
    )
