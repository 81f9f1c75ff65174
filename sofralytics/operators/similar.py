"""Fuzzy joins: near-duplicate names, the same venue on two platforms, misspelt dish names.

No step compares every pair.  Texts are reduced to distinct values, joined on rare shared character pairs,
filtered by lengths and shared-pair counts that every accepted pair must reach, and only then scored.
The filters follow from the thresholds, so the result equals that of an all-pairs comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.best_key import CONTAINED, MOST_KEYS, KeyIndex
from sofralytics.functions.geo import haversine_km
from sofralytics.functions.similarity import (
    alike_needs, grams, indel_ratio, inner_grams, letters, only_whole, shared_grams_needed, weighted_ratio_udf, window_needs,
    word_sort_key,
)
from sofralytics.functions.text import normalize, tokens
from sofralytics.operators.dictionary import MAX_WORDS, best_per_dish, candidates
from sofralytics.operators.sizing import bounded, spread, spread_by
from sofralytics.session import ensure_checkpoint_dir, written

# Below this ratio two short different texts may share no character pair at all.
LOWEST_BLOCKABLE = 76.0
SLACK = 1e-6


def _prefixed(texts: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """text, its grams rarest first, and the leading ones that two similar texts must have in common."""
    flat = texts.select("text", F.explode(grams(F.col("text"))).alias("g"))
    ranked = flat.join(frequency, "g").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("r"))
    length = F.length("text")
    # Fewest grams shared with any admissible partner; a partner is at least this much shorter.
    joint = length * (200.0 / (200.0 - threshold))
    needed = F.greatest(F.lit(1), F.ceil(joint * (3 * threshold / 200.0 - 1) + 1 - SLACK)).cast("int")
    ordered = F.transform("r", lambda x: x["g"])
    keep = F.greatest(F.lit(1), F.size("r") - needed + 1)
    return ranked.select("text", ordered.alias("grams"), F.slice(ordered, F.lit(1), keep).alias("prefix"))


def similar_texts(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b, ratio) of different texts whose ratio reaches the threshold; a < b when ``right`` is None.

    ``left`` and ``right`` hold distinct values in a column ``text``.
    """
    if threshold < LOWEST_BLOCKABLE:
        raise ValueError(f"threshold must be at least {LOWEST_BLOCKABLE}")
    every = left.select("text") if right is None else left.select("text").unionByName(right.select("text")).distinct()
    frequency = every.select(F.explode(grams(F.col("text"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    a = _prefixed(left, frequency, threshold).select(F.col("text").alias("a"), F.col("grams").alias("ga"), F.col("prefix").alias("pa"))
    other = left if right is None else right
    b = _prefixed(other, frequency, threshold).select(F.col("text").alias("b"), F.col("grams").alias("gb"), F.col("prefix").alias("pb"))
    ordered = F.col("a") < F.col("b") if right is None else F.col("a") != F.col("b")
    la, lb = F.length("a"), F.length("b")
    total = la + lb
    pairs = (
        a.withColumn("g", F.explode("pa"))
        .join(b.withColumn("g", F.explode("pb")), "g")
        .filter(ordered & (F.least(la, lb) * 200.0 >= total * (threshold - SLACK)))
        .filter(F.array_intersect("pa", "pb")[0] == F.col("g"))
        .filter(F.size(F.array_intersect("ga", "gb")) >= shared_grams_needed(total, threshold))
        .select("a", "b")
    )
    return spread_by(pairs, "a", "b").withColumn("ratio", indel_ratio("a", "b")).filter(F.col("ratio") >= threshold)


def all_pairs(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """The same result by comparing every pair; for small inputs and tests only."""
    a, b = left.select(F.col("text").alias("a")), (left if right is None else right).select(F.col("text").alias("b"))
    keep = F.col("a") < F.col("b") if right is None else F.col("a") != F.col("b")
    return a.join(b, keep).withColumn("ratio", indel_ratio("a", "b")).filter(F.col("ratio") >= threshold)


def _followers(keyed: DataFrame, k: int, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """(records with the next k ids of their key, per (key, chunk) the first k ids at or after it).

    A key is cut into id ranges of about ``chunk_rows`` rows, so a key that covers a third of all records
    still spreads over many tasks; ranges are linked through their first k ids only.
    """
    ensure_checkpoint_dir(keyed.sparkSession)
    # As doubles, since ids may be hashes of 64 bits; the rounding keeps the order of chunks.
    place = F.col("id").cast("double")
    stats = keyed.agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n"))
    width = F.greatest(F.lit(1.0), F.ceil((F.col("hi") - F.col("lo") + 1) / F.col("n") * chunk_rows).cast("double"))
    rows = keyed.withColumn("_w", stats.select(F.struct("lo", width.alias("w"))).scalar())
    rows = rows.withColumn("chunk", F.floor((place - F.col("_w")["lo"]) / F.col("_w")["w"]).cast("long")).drop("_w")
    inside = Window.partitionBy("key", "chunk").orderBy("id")
    ahead = F.collect_list("id").over(inside.rowsBetween(1, k))
    heads = (
        rows.withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") <= k)
        .groupBy("key", "chunk")
        .agg(F.array_sort(F.collect_list("id")).alias("heads"))
    )
    later = Window.partitionBy("key").orderBy("chunk").rowsBetween(1, k)
    linked = heads.withColumn("rest", F.slice(F.flatten(F.collect_list("heads").over(later)), 1, k)).checkpoint()
    near = rows.withColumn("near", ahead).join(linked.select("key", "chunk", "rest"), ["key", "chunk"])
    near = near.withColumn("next_ids", F.slice(F.concat("near", "rest"), 1, k)).drop("near", "rest")
    # Used by four branches; written once to the shared folder instead of being shuffled again for each.
    near = near.checkpoint()
    return near, linked.select("key", "chunk", F.slice(F.concat("heads", "rest"), 1, k).alias("from_here"))


def find_duplicates(
    records: DataFrame,
    column: str = "name",
    threshold: float = fv.DUPLICATE_THRESHOLD,
    per_record: int = fv.DUPLICATES_PER_RECORD,
    chunk_rows: int = 1_000_000,
    blocking: bool = True,
) -> DataFrame:
    """(source_id, target_id, score, match_type): for every record its best later near-duplicates.

    Ids give the list order; each record keeps its ``per_record`` best matches among later records, higher
    score first, then lower id.  Equal word-sorted names score 100.  A record followed by ``per_record`` equal
    ones is settled by them, so only the last few records of each distinct name look at other names, and they
    look up the next ids of a similar name instead of pairing with all of them.
    """
    k = per_record
    keyed = records.select(F.col("id").cast("long").alias("id"), word_sort_key(F.col(column)).alias("key"))
    near, linked = _followers(keyed, k, chunk_rows)
    exact = near.select("id", F.explode("next_ids").alias("target"), F.lit(100.0).alias("score"))

    names = keyed.select(F.col("key").alias("text")).distinct()
    pairs = (similar_texts if blocking else all_pairs)(names, None, threshold)
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = pairs.select("ratio", F.explode(ways).alias("w")).select("w.a", "w.b", "ratio")
    tails = near.filter(F.size("next_ids") < k).select("id", "key", "chunk", (F.lit(k) - F.size("next_ids")).alias("open"))
    probes = tails.join(both, tails["key"] == both["a"]).select("id", "chunk", "open", F.col("b").alias("key"), "ratio")

    # Members and probes of a name in id order; a probe takes the first member after it and that member's followers.
    none = F.lit(None)
    members = near.select("key", "chunk", "id", F.struct("id", "next_ids").alias("m"), none.cast("double").alias("ratio"), none.cast("int").alias("open"))
    asked = probes.select("key", "chunk", "id", none.cast("struct<id:bigint,next_ids:array<bigint>>").alias("m"), "ratio", "open")
    backward = Window.partitionBy("key", "chunk").orderBy(F.col("id").desc(), F.col("m").isNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
    met = members.unionByName(asked).withColumn("nxt", F.last("m", ignorenulls=True).over(backward)).filter(F.col("ratio").isNotNull())
    # No member left in this id range: continue at the name's next range that has any.
    ranges = linked.select("key", "chunk", "from_here").unionByName(
        met.select("key", "chunk").distinct().join(linked.select("key", "chunk"), ["key", "chunk"], "left_anti").withColumn("from_here", none.cast("array<bigint>"))
    )
    onward = Window.partitionBy("key").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("key", "chunk", F.last("from_here", ignorenulls=True).over(onward).alias("beyond"))
    found = met.join(ranges, ["key", "chunk"]).withColumn(
        "targets",
        F.when(F.col("nxt").isNotNull(), F.slice(F.concat(F.array(F.col("nxt.id")), F.col("nxt.next_ids")), 1, k)).otherwise(
            F.coalesce("beyond", F.array().cast("array<bigint>"))
        ),
    )
    fuzzy = found.select("id", "open", F.explode("targets").alias("target"), F.col("ratio").alias("score"))
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "target")
    fuzzy = fuzzy.withColumn("_rn", F.row_number().over(order)).filter((F.col("_rn") <= k) & (F.col("_rn") <= F.col("open")))
    return exact.unionByName(fuzzy.select("id", "target", "score")).select(
        F.col("id").alias("source_id"), F.col("target").alias("target_id"), "score",
        F.when(F.col("score") == 100.0, "exact").otherwise("fuzzy").alias("match_type"),
    )


def location_score(distance_km: Column | None) -> Column:
    """Fixed middle value without coordinates in use; with them 100 inside the allowed distance, else 0."""
    if distance_km is None:
        return F.lit(fv.MATCH_LOCATION_DEFAULT)
    return F.when(distance_km <= fv.MATCH_MAX_KM, 100.0).when(distance_km.isNotNull(), 0.0).otherwise(fv.MATCH_LOCATION_DEFAULT)


def match_venues(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Best target of another platform for every source venue.

    Both sides: id, name, address, phone.  Name ratio of at least 75 and a weighted score of at least 70.
    Without equal phones a score of 70 needs 0.35 name + 0.30 address >= 57.5, so one of the two ratios is at
    least 88.46: candidates are pairs with equal phones, with such names, or with such addresses.  Records
    that agree in name, address and phone are compared once; among equal targets the lowest id wins.
    """
    w = fv.MATCH_WEIGHTS
    strong = (fv.MATCH_OVERALL_GATE - w["location"] * fv.MATCH_LOCATION_DEFAULT) / (w["name"] + w["address"]) - 0.01
    part = lambda df: df.select(
        "id", word_sort_key(F.col("name")).alias("name"), word_sort_key(F.col("address")).alias("address"),
        F.when(F.col("phone") != "", F.col("phone")).alias("phone"),
    )
    shape = ["name", "address", "phone"]
    src = part(sources)
    ensure_checkpoint_dir(sources.sparkSession)
    kinds_s = src.select(*shape).distinct().select(*[F.col(c).alias(f"s_{c}") for c in shape]).checkpoint()
    kinds_t = part(targets).groupBy(*shape).agg(F.min("id").alias("target_id"))
    kinds_t = kinds_t.select("target_id", *[F.col(c).alias(f"t_{c}") for c in shape]).checkpoint()

    total = F.length("s_name") + F.length("t_name")
    shared = F.size(F.array_intersect(grams(F.col("s_name")), grams(F.col("t_name"))))
    plausible = (F.least(F.length("s_name"), F.length("t_name")) * 200.0 >= total * (fv.MATCH_NAME_GATE - SLACK)) & (
        shared >= shared_grams_needed(total, fv.MATCH_NAME_GATE)
    )
    by_phone = kinds_s.join(kinds_t, F.col("s_phone") == F.col("t_phone")).filter(plausible)

    def near(column: str) -> DataFrame:
        a = kinds_s.select(F.col(f"s_{column}").alias("text")).distinct()
        b = kinds_t.select(F.col(f"t_{column}").alias("text")).distinct()
        close = similar_texts(a, b, strong).select("a", "b").unionByName(a.join(b, "text").select(F.col("text").alias("a"), F.col("text").alias("b")))
        return (
            kinds_s.join(close, F.col(f"s_{column}") == F.col("a")).join(kinds_t, F.col("b") == F.col(f"t_{column}")).drop("a", "b").filter(plausible)
        )

    pairs = by_phone.unionByName(near("name")).unionByName(near("address")).dropDuplicates(["s_name", "s_address", "s_phone", "target_id"])
    scored = pairs.withColumn("name_similarity", indel_ratio("s_name", "t_name")).filter(F.col("name_similarity") >= fv.MATCH_NAME_GATE)
    same_phone = F.coalesce(F.col("s_phone") == F.col("t_phone"), F.lit(False))
    scored = scored.withColumn("address_similarity", indel_ratio("s_address", "t_address")).withColumn("phone_match", same_phone)
    score = (
        F.col("name_similarity") * w["name"] + F.col("address_similarity") * w["address"] + location_score(None) * w["location"]
        + F.when(F.col("phone_match"), 100.0).otherwise(0.0) * w["phone"]
    )
    kept = scored.withColumn("confidence", score).filter(F.col("confidence") >= fv.MATCH_OVERALL_GATE)
    best = kept.groupBy("s_name", "s_address", "s_phone").agg(
        F.max_by(
            F.struct("target_id", "name_similarity", "address_similarity", "phone_match", "confidence"),
            F.struct(F.round("confidence", 9).alias("c"), (-F.col("target_id")).alias("t")),
        ).alias("m")
    )
    same = [F.col("name") == F.col("s_name"), F.col("address") == F.col("s_address"), F.col("phone").eqNullSafe(F.col("s_phone"))]
    return src.join(best, same).select(F.col("id").alias("source_id"), "m.*")


def located_score(pairs: DataFrame) -> DataFrame:
    """Location component of venue pairs from their coordinates."""
    km = haversine_km(F.col("s_lat"), F.col("s_lng"), F.col("t_lat"), F.col("t_lng"))
    return pairs.withColumn("location_score", location_score(km))


LISTED_LENGTHS = 64


def _window_needed(short: Column, threshold: float, pairs: bool) -> Column:
    """Pairs (or characters) the shorter text of this length needs in common with the longer in the window case."""
    listed = F.array(*[F.lit(n) for n in window_needs(threshold, LISTED_LENGTHS, pairs)])
    if threshold >= 200.0:
        return short + 1
    joint = short * (200.0 / (200.0 - threshold))  # the fewest characters of the text and such a stretch
    beyond = F.ceil(joint * (3 * threshold / 200.0 - 1) - 1 - SLACK) if pairs else F.ceil(joint * threshold / 200.0 - SLACK)
    return F.when(short <= LISTED_LENGTHS, F.get(listed, short)).otherwise(F.greatest(F.lit(0), beyond).cast("int"))


def _alike_needed(length: Column, threshold: float) -> Column:
    listed = F.array(*[F.lit(n) for n in alike_needs(threshold, LISTED_LENGTHS)])
    beyond = F.ceil(length * (200.0 / (200.0 - threshold)) * (3 * threshold / 200.0 - 1) + 1 - SLACK).cast("int")
    return F.when(length <= LISTED_LENGTHS, F.get(listed, length)).otherwise(F.greatest(F.lit(1), beyond))


def _word_set(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, " ")), " ")


def _set_length(text: Column) -> Column:
    return F.length(_word_set(text))


def _tagged(tag: int, values: Column) -> Column:
    return F.transform(values, lambda g: F.concat(F.lit(f"{tag}"), g))


def _leading(values: Column, needed: Column) -> Column:
    """Of the values, in an order that is the same everywhere, as many that two sets sharing ``needed`` meet in one."""
    return F.slice(F.sort_array(values, asc=False), F.lit(1), F.greatest(F.lit(0), F.size(values) - needed + 1))


def plausible_pairs(texts: DataFrame, keys: DataFrame, threshold: float, near_only: bool = False) -> DataFrame:
    """(text, key) of all pairs whose weighted ratio may reach the threshold; texts and keys are distinct.

    With ``near_only`` those of them whose lengths are less than 1.5 times apart.

    Texts meet keys in one equi-join on tagged index entries, each case with as few of them as its bound allows:

    * similar lengths: the leading pairs of both, of the whole texts and of their distinct words;
    * the key nearly inside the text (lengths at least 1.5 times apart): the key's rarest pairs, and all of the text;
    * the text nearly inside the key: the text's leading pairs, and all of the key;
    * a word in common, where that alone lifts the score to the threshold or the lengths are close.

    Pairs met are kept if they share as many character pairs as their case needs.  A single letter and a longer text
    around it share no entry: they meet by the letter.
    """
    if threshold < LOWEST_BLOCKABLE:
        return _counted_pairs(texts, keys, threshold)
    window = threshold / 0.9 - SLACK
    d = keys.select("key", F.length("key").alias("lk"), grams(F.col("key")).alias("kg"))
    reach = d.agg(F.max("lk").alias("hi"), F.min("lk").alias("lo"))
    longest, shortest = (reach.select(c).scalar() for c in ("hi", "lo"))
    lt = F.length("text")
    t = spread_by(texts.select("text").filter((lt * 8 >= shortest) & (lt <= longest * 8)), "text")  # farther apart none is scored
    t = t.select("text", lt.alias("lt"), grams(F.col("text")).alias("tg"))

    words = lambda c: _tagged(4, F.array_distinct(F.split(c, " ")))

    def leading(c: str, g: str, size: str, lengths) -> Column:
        """Entries for similar lengths, each with a length of the text that it is meant for."""
        of = lambda gs, n: F.flatten(F.transform(lengths(n), lambda m: F.transform(_leading(gs, _alike_needed(n, threshold)), lambda x: F.concat(F.lit("3"), m.cast("string"), F.lit(":"), x))))
        fewer = F.when(_set_length(F.col(c)) < F.col(size), of(grams(_word_set(F.col(c))), _set_length(F.col(c)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(of(F.col(g), F.col(size)), fewer))

    ratio = threshold / (200.0 - threshold)  # a partner is at least this much as long
    partners = lambda n: F.sequence(F.ceil(n * ratio - SLACK).cast("int"), F.floor(n / ratio + SLACK).cast("int"))
    # The window case looks at the texts as they are and, with a lower weight, at their sorted words.
    none = F.array().cast("array<string>")
    resorted = lambda c, n: F.when(F.contains(c, F.lit(" ")), _leading(inner_grams(word_sort_key(c)), _window_needed(n, window / 0.95, True))).otherwise(none)
    own_window = F.concat(_leading(inner_grams(F.col("text")), _window_needed(F.col("lt"), window, True)), resorted(F.col("text"), F.col("lt")))
    inside_text = F.when(F.col("lt") * 3 <= longest * 2, _tagged(2, F.array_distinct(own_window))).otherwise(none)
    near_entries = [leading("text", "tg", "lt", F.array), words(F.col("text"))]
    t_entries = F.concat(*near_entries) if near_only else F.concat(_tagged(1, F.col("tg")), inside_text, *near_entries)
    # Entries of the keys' own pairs, rarest first by how many keys have them.
    inner = d.select("key", "lk", F.explode(inner_grams(F.col("key"))).alias("g"))
    often = inner.groupBy("g").agg(F.count("*").alias("n"))
    ranked = inner.join(often, "g").groupBy("key", "lk").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("r"))
    rarest = F.slice("r", F.lit(1), F.greatest(F.lit(0), F.size("r") - _window_needed(F.col("lk"), window, True) + 1))
    rare = ranked.select("key", F.explode(_tagged(1, F.array_distinct(F.concat(rarest, resorted(F.col("key"), F.col("lk")))))).alias("e"))
    near_entries = [leading("key", "kg", "lk", partners), words(F.col("key"))]
    others = d.select("key", F.explode(F.concat(*near_entries) if near_only else F.concat(_tagged(2, F.col("kg")), *near_entries)).alias("e"))
    k_index = (others if near_only else rare.unionByName(others)).join(d, "key").withColumn("lku", _set_length(F.col("key")))

    met = t.select("text", "lt", "tg", F.explode_outer(t_entries).alias("e")).join(bounded(k_index), "e")
    tag, lt, lk = F.substring("e", 1, 1), F.col("lt"), F.col("lk")
    short, long = F.least(lt, lk), F.greatest(lt, lk)
    apart = (long * 2 >= short * 3) & (long <= short * 8)
    shared = F.size(F.array_intersect("tg", "kg"))

    def similar(a: Column, b: Column) -> Column:
        return (F.least(a, b) * 200.0 >= (a + b) * (threshold - SLACK)) & (shared >= shared_grams_needed(a + b, threshold))

    close = long * 2 < short * 3
    keep = (
        F.when(tag == "1", apart & (lk < lt) & (shared >= _window_needed(lk, window, True)))
        .when(tag == "2", apart & (lt < lk) & (shared >= _window_needed(lt, window, True)))
        .when(tag == "3", similar(lt, lk) | similar(_set_length(F.col("text")), F.col("lku")))
        .otherwise(close | (apart & F.lit(0.9 * 95.0 >= threshold - SLACK)))
    )
    found = met.filter(keep & close if near_only else keep).select("text", "key").distinct()
    if near_only or threshold > 90.0:
        return found
    lettered = lambda f, c: f.select(c, F.explode(F.array_distinct(F.split(c, ""))).alias("g")).filter("g <> ''")
    single = lambda f, c: f.filter(F.length(c) == 1).select(c, F.col(c).alias("g"))
    near = F.length("text") * F.length("key") <= 8
    one_text = single(t, "text").join(bounded(lettered(d, "key")), "g").filter(near).select("text", "key")
    one_key = lettered(t.filter("lt <= 8"), "text").join(bounded(single(d, "key")), "g").filter(near).select("text", "key")
    return found.unionByName(one_text).unionByName(one_key).distinct()


def _counted_pairs(texts: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """``plausible_pairs`` for low thresholds, where similar texts may share no character pair at all.

    The index maps characters and words of the keys to keys; a text's entries are met with it and counted for each key
    in one aggregation, and the counts decide.
    """
    t, d = texts.select("text"), keys.select("key")
    far = threshold <= 60.0  # lengths more than 8 times apart can still reach the threshold
    if not far:
        reach = d.agg(F.max(F.length("key")).alias("hi"), F.min(F.length("key")).alias("lo"))
        t = t.filter((F.length("text") * 8 >= reach.select("lo").scalar()) & (F.length("text") <= reach.select("hi").scalar() * 8))
    t = spread_by(t, "text")

    def indexed(frame: DataFrame, column: str) -> DataFrame:
        words = _tagged(0, F.array_distinct(F.split(column, " ")))
        return frame.select(column, F.explode(F.concat(_tagged(1, letters(F.col(column))), words)).alias("g"))

    is_word = F.startswith(F.col("g"), F.lit("0"))
    lt, lk = F.length("text"), F.length("key")
    short, long = F.least(lt, lk), F.greatest(lt, lk)
    apart = (long * 2 >= short * 3) & (F.lit(far) | (long <= short * 8))
    close = long * 2 < short * 3
    met = indexed(t, "text").join(bounded(indexed(d, "key")), "g").filter(close | apart)
    counted = met.groupBy("text", "key").agg(F.count_if(~is_word).alias("shared"), F.count_if(is_word).alias("words"))

    def alike(a: Column, b: Column) -> Column:
        return (F.least(a, b) * 200.0 >= (a + b) * (threshold - SLACK)) & (F.col("shared") >= F.ceil((a + b) * (threshold / 200.0) - SLACK))

    inside = apart & (F.col("shared") >= _window_needed(short, threshold / 0.9 - SLACK, False))
    scale = F.when(long <= short * 8, 0.9).otherwise(0.6)
    common_word = (F.col("words") > 0) & (close | (scale * 95.0 >= threshold - SLACK))
    return counted.filter(alike(lt, lk) | alike(_set_length(F.col("text")), _set_length(F.col("key"))) | inside | common_word).select("text", "key")


def _whole_score(threshold: float) -> Column:
    """The weighted ratio of (text, key) where it follows from whole words and containment alone, else null.

    With lengths 1.5 to 8 times apart and a shorter text so short that a window ratio that matters means that the longer
    contains it, the score is 90 (contained), 85.5 (a common word, or contained with sorted words) or too low.
    """
    text, key = F.col("text"), F.col("key")
    short, long = F.when(F.length(text) <= F.length(key), text).otherwise(key), F.when(F.length(text) <= F.length(key), key).otherwise(text)
    limit = only_whole(min(threshold / 0.9, 95.0), LISTED_LENGTHS)
    apart = (F.length(long) * 2 >= F.length(short) * 3) & (F.length(long) <= F.length(short) * 8)
    common = F.arrays_overlap(F.split(text, " "), F.split(key, " ")) | F.contains(word_sort_key(long), word_sort_key(short))
    known = apart & (F.length(short) <= limit) & F.lit(threshold > 80.0)
    return F.when(known, F.when(F.contains(long, short), 90.0).when(common, 85.5).otherwise(0.0))


def _fuzzy_pairs(texts: DataFrame, keys: DataFrame, threshold: float, near_only: bool = False) -> DataFrame:
    """(text, key, score) with a weighted ratio of at least the threshold."""
    pairs = plausible_pairs(texts, keys, threshold, near_only).withColumn("whole", _whole_score(threshold))
    pairs = spread_by(pairs.filter("whole IS NULL OR whole > 0"), "text", "key")
    open_text = F.when(F.col("whole").isNull(), F.col("text"))
    scored = pairs.withColumn("score", F.coalesce("whole", weighted_ratio_udf(open_text, "key", F.lit(threshold - SLACK))))
    return scored.select("text", "key", "score").filter(F.col("score") >= threshold)


def fuzzy_lookup(queries: DataFrame, lookup: DataFrame, column: str = "query", threshold: float = fv.FUZZY_LOOKUP_THRESHOLD, limit: int = fv.FUZZY_LOOKUP_LIMIT) -> DataFrame:
    """(text, canonical, score): dishes similar to each distinct normalised query.

    The ``limit`` most similar keys are taken first, then one row per canonical name is kept.
    """
    texts = queries.select(normalize(F.col(column)).alias("text")).filter("text <> ''").distinct()
    pairs = _fuzzy_pairs(texts, lookup.select("key"), threshold).unionByName(
        texts.join(lookup.select("key"), F.col("text") == F.col("key")).select("text", "key", F.lit(100.0).alias("score"))
    ).dropDuplicates(["text", "key"])
    rows = pairs.join(lookup, "key")
    order = Window.partitionBy("text").orderBy(F.col("score").desc(), "key_order")
    best = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit)
    return best.groupBy("text", "canonical").agg(F.max("score").alias("score"))


def contained_keys(texts: DataFrame, lookup: DataFrame) -> DataFrame:
    """(text, key): for each text the first key (by ``key_order``) that it contains or that contains it, lengths 1.5 to 8 times apart.

    Texts are distinct.  A key inside a text is met by its rarest character pair (a letter by itself), a text inside a key by
    the stretches of the keys.
    """
    lt, lk = F.length("text"), F.length("key")
    first = F.min_by("key", "key_order").alias("key"), F.min("key_order").alias("key_order")
    pairs_of = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    keys = lookup.select("key", "key_order")
    entries = keys.select("key", "key_order", F.explode(F.when(lk > 1, pairs_of(F.col("key"))).otherwise(F.array("key"))).alias("g"))
    often = entries.groupBy("g").agg(F.count("*").alias("n"))
    rarest = entries.join(often, "g").groupBy("key", "key_order").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    # A letter reaches texts of up to eight characters only.
    none = F.array().cast("array<string>")
    own = F.concat(F.when(lt > 1, pairs_of(F.col("text"))).otherwise(none), F.when(lt <= 8, F.split("text", "")).otherwise(none))
    met = texts.select("text", F.explode(F.array_distinct(own)).alias("g")).join(bounded(rarest), "g")
    inside = met.filter((lt * 2 >= lk * 3) & (lt <= lk * 8) & F.contains("text", F.col("key")))
    starts = keys.select("key", "key_order", F.explode(F.sequence(F.lit(1), lk)).alias("i"))
    stretches = starts.select("key", "key_order", "i", F.explode(F.sequence(F.lit(1), lk - F.col("i") + 1)).alias("n"))
    stretches = stretches.filter((lk >= F.col("n") * 1.5) & (lk <= F.col("n") * 8))
    stretches = stretches.groupBy(F.call_function("substring", F.col("key"), F.col("i"), F.col("n")).alias("text")).agg(*first)
    around = texts.select("text").join(bounded(stretches), "text")
    return inside.select("text", "key", "key_order").unionByName(around).groupBy("text").agg(*first).select("text", "key")


def best_keys(texts: DataFrame, lookup: DataFrame, threshold: float) -> DataFrame:
    """(text, canonical, score): the most similar key of each distinct text, of equal scores the first by ``key_order``.

    Lengths at least 1.5 times apart score ``CONTAINED`` at most.  So a text that contains a key, or lies in one, is compared
    only with keys of similar length at that threshold; all pairs are looked for only where no key is contained.
    """
    keys = lookup.select("key")
    if threshold <= CONTAINED:
        inside = written(contained_keys(texts, lookup), "contained")
        rest = texts.join(inside, "text", "left_anti")
        pairs = _fuzzy_pairs(rest, keys, threshold).unionByName(_fuzzy_pairs(inside.select("text"), keys, CONTAINED, near_only=True))
        pairs = pairs.unionByName(inside.withColumn("score", F.lit(CONTAINED)))
    else:
        pairs = _fuzzy_pairs(texts, keys, threshold)
    best = F.min_by(F.struct("canonical", "score"), F.struct((-F.col("score")).alias("s"), F.col("key_order").alias("o")))
    return pairs.join(bounded(lookup), "key").groupBy("text").agg(best.alias("b")).select("text", "b.*")


WORDS_AT_ONCE = 100_000


def _runs_of(flat: pa.Array, end: np.ndarray, low: int, high: int):
    """The runs of up to four words that begin at the words from ``low`` to before ``high``: their distinct strings, and for each
    run its string's number, its number of words and the place of its first word.
    """
    coded = flat.slice(low, high - low + MAX_WORDS - 1).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    texts, place, number, strings, told = words, np.arange(high - low), code[: high - low], [], 0
    runs = []
    for n in range(1, MAX_WORDS + 1):
        if n > 1:  # the runs one word shorter, where the text goes on
            on = low + place + n <= end[low + place]
            place = place[on]
            both, number = np.unique(number[on] * len(words) + code[place + n - 1], return_inverse=True)
            texts = pc.binary_join_element_wise(texts.take(pa.array(both // len(words))), words.take(pa.array(both % len(words))), " ")
        strings.append(texts)
        runs.append((number + told, np.full(len(place), n), place + low))
        told += len(texts)
    return pa.concat_arrays(strings), *(np.concatenate(part) for part in zip(*runs))


def _mentions_by_few_keys(reviews: DataFrame, entries: list, threshold: float) -> DataFrame:
    """The best run per review and dish as far as a task sees them, with keys few enough to be sent to every task.

    ``entries``: (key, canonical) in the order of ``key_order``.  The distinct runs of some 100,000 words at a time are compared
    with the keys, so nothing is shuffled before the runs are reduced to dishes.
    """
    keys, canonicals = [e[0] for e in entries], sorted({e[1] for e in entries})
    dish_of = [canonicals.index(e[1]) for e in entries]

    def run(batches):
        index, dishes, names = KeyIndex(keys, threshold), np.array(dish_of), pa.array(canonicals, pa.string())
        known, stop = pa.array(keys, pa.string()), pa.array(fv.TURKISH_STOPWORDS, pa.string())
        for batch in batches:
            lists = batch.column("w")
            flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            review = np.repeat(np.arange(len(lists)), np.diff(bounds))
            for low in range(0, len(flat), WORDS_AT_ONCE):
                texts, number, n, place = _runs_of(flat, bounds[1:][review], low, min(low + WORDS_AT_ONCE, len(flat)))
                size = pc.utf8_length(texts).to_numpy()
                forms = texts
                odd = pc.match_substring(texts, "_")
                if pc.any(odd).as_py():  # tokens are lower-cased words already; only an underscore still needs normalising
                    forms = pc.if_else(odd, pc.utf8_trim_whitespace(pc.replace_substring_regex(texts, "[_ ]+", " ")), texts)
                same = pc.index_in(forms, value_set=known).fill_null(-1).to_numpy()
                key, score = np.where(same >= 0, same, len(keys)), np.where(same >= 0, 100.0, 0.0)
                asked = np.flatnonzero((same < 0) & (size >= 3) & ~pc.is_in(texts, value_set=stop).to_numpy(zero_copy_only=False))
                wanted = forms.take(pa.array(asked)).dictionary_encode()
                best, value = index.best(wanted.dictionary.to_pylist())
                key[asked], score[asked] = best[wanted.indices.to_numpy()], value[wanted.indices.to_numpy()]
                # Highest score, then longest text, then fewest words, then the first.
                _, rank = np.unique(-score * (1 << 20) - size, return_inverse=True)
                hit = np.flatnonzero(key[number] < len(keys))
                number, n, place = number[hit], n[hit], place[hit]
                start, dish = place - bounds[review[place]], dishes[key[number]]
                group = review[place] * len(canonicals) + dish
                order = np.lexsort(((rank[number] << 35) + (n << 32) + start, group))
                kept = order[np.flatnonzero(np.diff(group[order], prepend=-1))]
                number, method = number[kept], np.where(same[number[kept]] >= 0, "exact", "fuzzy")
                found = {
                    "review_id": batch.column("review_id").take(pa.array(review[place[kept]])), "canonical": names.take(pa.array(dish[kept])),
                    "n": pa.array(n[kept], pa.int32()), "start": pa.array(start[kept], pa.int32()),
                    "matched_text": texts.take(pa.array(number)), "score": pa.array(score[number]), "method": pa.array(method, pa.string()),
                }
                yield pa.RecordBatch.from_pydict(found)

    rows = spread(reviews.select("review_id", "text")).select("review_id", tokens(F.col("text")).alias("w"))
    kind = rows.schema["review_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"review_id {kind}, canonical string, n int, start int, matched_text string, score double, method string")
    return found.select("review_id", "canonical", F.struct("n", "start").alias("position"), "matched_text", "score", "method")


def fuzzy_mentions(reviews: DataFrame, lookup: DataFrame, threshold: float = fv.FUZZY_DISH_THRESHOLD) -> DataFrame:
    """Dishes named in each review literally or misspelt, best match per dish.

    Word runs that are no dictionary key, have at least three characters and are no stop word are compared with the
    dictionary: inside the tasks that make them where its keys are few, else once per distinct run, then joined back.
    """
    few = sorted((r["key_order"], r["key"], r["canonical"]) for r in lookup.select("key_order", "key", "canonical").limit(MOST_KEYS + 1).collect())
    if KeyIndex.takes([key for _, key, _ in few], threshold):
        return best_per_dish(_mentions_by_few_keys(reviews, [(key, canonical) for _, key, canonical in few], threshold))
    runs = candidates(reviews)
    hits = runs.join(bounded(lookup.select("key", "canonical")), "key").select(
        "review_id", "canonical", "position", F.col("candidate").alias("matched_text"), F.lit(100.0).alias("score"), F.lit("exact").alias("method")
    )
    open_runs = runs.join(bounded(lookup.select("key")), "key", "left_anti").filter(
        (F.length("candidate") >= 3) & ~F.col("candidate").isin(*fv.TURKISH_STOPWORDS)
    )
    distinct = written(open_runs.select(F.col("key").alias("text")).distinct(), "runs")
    best = best_keys(distinct, lookup, threshold)
    loose = open_runs.join(best, F.col("key") == F.col("text")).select(
        "review_id", "canonical", "position", F.col("candidate").alias("matched_text"), "score", F.lit("fuzzy").alias("method")
    )
    return best_per_dish(hits.unionByName(loose))
