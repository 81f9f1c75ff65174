"""Hand-computed fixtures and brute-force comparisons."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sofralytics.functions import similarity as sim
from sofralytics.operators import detail, dictionary, extract_html, ordered, places, requestlog, scoring, search, sentiment, similar


def test_dish_score_by_hand(spark):
    rows = [(1, "Adana ", "POSITIVE", 0.9, 5), (1, "adana", "negative", 0.6, 1), (1, "adana", "neutral", 0.4, 3), (1, "ayran", None, 0.9, 5),
            (1, " ", "positive", 0.9, 5), (2, "pide", "positive", 0.8, None)]
    frame = spark.createDataFrame(rows, "restaurant_id int, food string, sentiment string, confidence double, star_rating int")
    got = {(r.restaurant_id, r.food): r for r in scoring.score_dishes(frame).collect()}
    adana = got[(1, "adana")]
    combined = (0.9 - 0.6) / 1.5
    assert adana.score == round((combined + 1) / 2 * 9 + 1, 2)
    assert (adana.positive_count, adana.neutral_count, adana.negative_count, adana.review_count, adana.enough_data) == (1, 1, 1, 3, True)
    assert adana.confidence == 0.75
    assert (got[(1, "ayran")].score, got[(1, "ayran")].review_count) == (5.5, 0)
    assert got[(2, "pide")].score == round((0.7 + 1) / 2 * 9 + 1, 2)
    assert got[(2, "pide")].confidence == round(0.8 / 3, 4)
    assert len(got) == 3


def test_scores_do_not_depend_on_partitions(tables):
    one = {tuple(r) for r in scoring.score_dishes(tables.mentions_v.repartition(1)).collect()}
    many = {tuple(r) for r in scoring.score_dishes(tables.mentions_v.repartition(17)).collect()}
    assert one == many and all(1.0 <= r[2] <= 10.0 for r in one)


def test_ensemble_branches(spark):
    rows = [(1, 0.8, 1, 0.9), (1, 0.8, -1, 0.3), (1, 0.6, -1, 0.6)]
    frame = spark.createDataFrame(rows, "model_label int, model_score double, weak_label int, weak_confidence double")
    got = [(r.final_label, r.confidence) for r in sentiment.ensemble(frame).collect()]
    assert got == [(1, 0.95), (1, 0.56), (-1, 0.48)]


@pytest.mark.parametrize(
    "item, kind",
    [("çay", "icecek"), ("soğuk kahve", "icecek"), ("taze sıkılmış portakal suyu", "icecek"), ("peçete", "yan_urun"), ("plastik çatal", "yan_urun"),
     ("Adana kebap", "yemek"), ("çay yaprağı sarması", "yemek"), ("mercimek çorbası", "yemek"), ("", "yemek")],
)
def test_item_class(spark, item, kind):
    got = spark.createDataFrame([(item,)], "i string").select(dictionary.classify_item(F.col("i")).alias("c")).first()["c"]
    assert got["type"] == kind


DISHES = [(0, "Adana Kebap", ["adana"], "kebap", "guney"), (1, "Mercimek Çorbası", ["mercimek"], "corba", None), (2, "Ayran", [], "icecek", None)]
DISH_SCHEMA = "load_position long, canonical string, aliases array<string>, category string, region string"


def test_menu_items_are_classified_once(spark):
    """The plan lower-cases an item once, not once for every keyword it is searched for."""
    menus = spark.createDataFrame([(1, ["Adana Kebap", " AYRAN ", "Peçete", "çay", None]), (2, []), (3, None)], "m long, items array<string>")
    got = dictionary.menu_buckets(menus)
    rows = {r.m: (r.foods, r.beverages, r.side_items, r.unknown) for r in got.collect()}
    assert rows == {1: (["Adana Kebap", None], [" AYRAN ", "çay"], ["Peçete"], []), 2: ([], [], [], []), 3: (None, None, None, [])}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(lower(") <= 1


def test_exact_hits_are_reduced_by_hash(spark):
    """A word costs the same in a long text as in a short one, and repeats of a name are not sorted."""
    lookup = dictionary.lookup_table(spark.createDataFrame(DISHES, DISH_SCHEMA))
    text = "ayran " * 3000 + "Adana Kebap adana adana_kebap ayranlı adana kebapçı mercimek"
    reviews = spark.createDataFrame([(1, text), (1, "adana__kebap"), (2, "_ayran_"), (3, "_")], "review_id long, text string")
    found = dictionary.exact_mentions(reviews, lookup)
    got = {(r.review_id, r.canonical): r.matched_text for r in found.collect()}
    assert got == {(1, "Adana Kebap"): "adana__kebap", (1, "Mercimek Çorbası"): "mercimek", (1, "Ayran"): "ayran", (2, "Ayran"): "_ayran_"}
    windows = dictionary.word_windows(reviews)
    assert [r.run for r in windows.filter("review_id = 1 AND start >= 2998 AND start < 3001").orderBy("start").collect()] == [
        "ayran ayran adana kebap", "ayran adana kebap adana", "adana kebap adana adana_kebap"
    ]
    assert "slice(" not in windows._jdf.queryExecution().optimizedPlan().toString()
    assert "HashAggregate(keys=[review_id" in found._jdf.queryExecution().executedPlan().toString().replace("key=", "keys=").replace("SortAggregate", "")


def test_exact_hits_are_one_compiled_stage(spark, capsys):
    """Words, join and first aggregation are compiled together, in methods short enough for the JVM; runs with underscores as by hand."""
    lookup = dictionary.lookup_table(spark.createDataFrame(DISHES, DISH_SCHEMA))
    keys = {r["key"]: r["canonical"] for r in lookup.collect()}
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["adana", "kebap", "kebap_", "_", "adana_kebap", "ayran", "mercimek", "çorbası", "__corbasi", "Kebap"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    found = dictionary.exact_mentions(reviews, lookup)
    expected = {}
    for i, words in enumerate(t.lower().split() for t in texts):
        for n in range(1, 5):
            for start in range(len(words) - n + 1):
                run = " ".join(words[start : start + n])
                name = keys.get(" ".join(run.replace("_", " ").split()))
                if name and len(run) > len(expected.get((i, name), "")):
                    expected[i, name] = run
    assert {(r.review_id, r.canonical): r.matched_text for r in found.collect()} == expected and len(expected) > 300
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        dictionary.exact_mentions(reviews, lookup).explain("codegen")
        stages = capsys.readouterr().out.split("== Subtree ")[1:]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    plans = [s.split("Generated code")[0] for s in stages]
    assert any("Generate posexplode" in p and "BroadcastHashJoin" in p and "HashAggregate" in p for p in plans)
    assert all(int(size) < 8000 for s in stages for size in re.findall(r"maxMethodCodeSize:(\d+)", s))


def test_exact_and_fuzzy_mentions(spark):
    entries = spark.createDataFrame(DISHES, DISH_SCHEMA)
    lookup = dictionary.lookup_table(entries)
    reviews = spark.createDataFrame([(1, "Adana kebap ve adana_kebap, mercimek corbasi!"), (2, "Adna kebap ile AYRAN içtik"), (3, None)], "review_id long, text string")
    exact = {(r.review_id, r.canonical): r.matched_text for r in dictionary.exact_mentions(reviews, lookup).collect()}
    assert exact == {(1, "Adana Kebap"): "adana_kebap", (1, "Mercimek Çorbası"): "mercimek corbasi", (2, "Ayran"): "ayran"}
    fuzzy = {(r.review_id, r.canonical): r for r in similar.fuzzy_mentions(reviews, lookup).collect()}
    assert fuzzy[(2, "Adana Kebap")].method == "fuzzy" and fuzzy[(2, "Adana Kebap")].score >= 85
    got = {r.canonical: r for r in dictionary.extracted_dishes(dictionary.exact_mentions(reviews, lookup), entries).collect()}
    assert got["Ayran"].category == "icecek" and not got["Ayran"].is_food and got["Adana Kebap"].region == "guney"


def test_ratios():
    assert sim.ratio("abcd", "abxd") == 75.0 and sim.ratio("", "") == 100.0
    assert sim.weighted_ratio("adana", "adana kebap") == pytest.approx(90.0)
    assert sim.weighted_ratio("kebap adana", "adana kebap") == pytest.approx(95.0)
    assert sim.weighted_ratio("", "a") == 0.0
    assert sim.word_set_ratio("a b", "a b c") == 100.0


def _names(seed, n):
    rng = random.Random(seed)
    syllables = ["ka", "de", "niz", "ke", "bap", "lok", "an", "ta", "su", "ev", "li"]
    base = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    def typo(s):
        i = rng.randrange(len(s))
        return s[:i] + rng.choice(["", "x", s[i] * 2]) + s[i + 1 :]
    return base + [typo(b) for b in base] + [typo(typo(b)) for b in base[: n // 2]] + base[: n // 3]


@pytest.mark.parametrize("threshold", [85.0, 88.45])
def test_blocking_loses_no_pair(spark, threshold):
    texts = spark.createDataFrame([(s,) for s in sorted({" ".join(sorted(n.split())) for n in _names(3, 80)} - {""})], "text string")
    blocked = {tuple(r) for r in similar.similar_texts(texts, None, threshold).collect()}
    assert blocked == {tuple(r) for r in similar.all_pairs(texts, None, threshold).collect()} and blocked


def _duplicates_by_hand(names):
    keys = [" ".join(sorted((n or "").split())) for n in names]
    out = set()
    for i, a in enumerate(keys):
        scored = sorted(((-sim.ratio(a, b), j) for j, b in enumerate(keys) if j > i and sim.ratio(a, b) >= 85))[:5]
        out |= {(i, j, round(-s, 6)) for s, j in scored}
    return out


@pytest.mark.parametrize("chunk_rows", [7, 1_000_000])
def test_duplicates_equal_brute_force_under_skew(spark, chunk_rows):
    names = _names(5, 25)
    names += ["deniz kebap evi"] * (len(names) // 2) + ["deniz kebab evi", "evi deniz kebap", None, "", "deniz kebap evii"]
    random.Random(1).shuffle(names)
    frame = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = similar.find_duplicates(frame, chunk_rows=chunk_rows).collect()
    assert {(r.source_id, r.target_id, round(r.score, 6)) for r in got} == _duplicates_by_hand(names)
    assert all((r.match_type == "exact") == (r.score == 100.0) for r in got)


ODD_WORDS = ["a", "k", "x", "ab", "ka", "aa", "k a", "a k a", "kebap kebap", "kebap kebap ka", "abcdefgh", "bcdefghij k", "su ev li ta an lok bap ke niz de ka", "a" * 70, "kebap " * 14 + "x"]


@pytest.mark.parametrize("threshold", [50.0, 75.0, 85.0, 90.0, 95.0])
def test_fuzzy_pairs_equal_brute_force(spark, threshold):
    keys = sorted({*_names(9, 25), *ODD_WORDS, "b", "abc"} - {""})
    queries = sorted({*_names(10, 25), *ODD_WORDS, "e", "kaa"} - {""})
    lookup = spark.createDataFrame([(k,) for k in keys], "key string")
    texts = spark.createDataFrame([(q,) for q in queries], "text string")
    got = {(r.text, r.key): round(r.score, 6) for r in similar._fuzzy_pairs(texts, lookup, threshold).collect()}
    assert got == {(q, k): round(sim.weighted_ratio(q, k), 6) for q in queries for k in keys if sim.weighted_ratio(q, k) >= threshold}
    if threshold >= 85.0:  # few pairs are scored besides those that are kept
        assert similar.plausible_pairs(texts, lookup, threshold).count() < 2 * len(got) + 0.02 * len(keys) * len(queries)


@pytest.mark.parametrize("threshold", [50.0, 85.0, 95.0])
def test_best_keys_equal_brute_force(spark, threshold):
    """Also that a text with a key inside it is scored with keys of similar length only."""
    keys = [*random.Random(2).sample(sorted({*_names(9, 25), *ODD_WORDS, "b", "abc", "kedeniz"} - {""}), 60), "ka", "a"]
    keys = list(dict.fromkeys(keys))
    queries = sorted({*_names(10, 25), *_names(9, 10), *ODD_WORDS, "e", "kaa", "denizke"} - {"", *keys})
    rows = [(k, f"C{i}", (i, 0, 0)) for i, k in enumerate(keys)]
    lookup = spark.createDataFrame(rows, "key string, canonical string, key_order struct<a:long,b:int,c:int>")
    texts = spark.createDataFrame([(q,) for q in queries], "text string")
    got = {r.text: (r.canonical, round(r.score, 6)) for r in similar.best_keys(texts, lookup, threshold).collect()}
    scored = {q: max(((round(sim.weighted_ratio(q, k), 6), -i) for i, k in enumerate(keys))) for q in queries}
    assert got == {q: (f"C{-i}", score) for q, (score, i) in scored.items() if score >= threshold}
    inside = similar.contained_keys(texts, lookup)
    by_hand = {q: [k for k in keys if (k in q or q in k) and 1.5 <= max(len(q), len(k)) / min(len(q), len(k)) <= 8] for q in queries}
    assert {r.text: r.key for r in inside.collect()} == {q: found[0] for q, found in by_hand.items() if found}
    near = similar.plausible_pairs(inside.select("text"), lookup.select("key"), 90.0, near_only=True)
    assert near.count() < similar.plausible_pairs(texts, lookup.select("key"), 85.0).count() / 2


def test_fuzzy_lookup_finds_a_longer_key_from_one_letter(spark):
    lookup = spark.createDataFrame([("ab", "Ab", (0, 0, 0)), ("xyz", "Xyz", (1, 0, 0))], "key string, canonical string, key_order struct<a:long,b:int,c:int>")
    asked = spark.createDataFrame([("a",)], "query string")
    assert [tuple(r) for r in similar.fuzzy_lookup(asked, lookup, threshold=75.0).collect()] == [("a", "Ab", 90.0)]


def test_window_needs_are_met_by_every_window():
    rng = random.Random(8)
    for threshold in (60.0, 85.0, 94.4):
        needs = {pairs: sim.window_needs(threshold, 12, pairs) for pairs in (True, False)}
        for _ in range(4000):
            short = "".join(rng.choices("ab", k=rng.randint(1, 8)))
            long = "".join(rng.choices("abc", k=rng.randint(len(short), 12)))
            if sim.window_ratio(short, long) < threshold:
                continue
            pair_counts = [Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (short, long)]
            assert (pair_counts[0] & pair_counts[1]).total() >= needs[True][len(short)]
            assert (Counter(short) & Counter(long)).total() >= needs[False][len(short)]


def test_match_venues(spark):
    schema = "id long, name string, address string, phone string"
    a = spark.createDataFrame([(1, "Deniz Restoran", "Moda Cad 3", "+90"), (2, "Koy Evi", "Uzak Sokak", None), (3, "Deniz Restoran", "Moda Cad 3", "+90")], schema)
    b = spark.createDataFrame([(10, "Restoran Deniz", "Moda Cad. 3", "+90"), (11, "Restoran Deniz", "Moda Cad. 3", "+90"), (12, "Baska Yer", "Uzak Sokak", None)], schema)
    got = {r.source_id: (r.target_id, r.phone_match) for r in similar.match_venues(a, b).collect()}
    assert got == {1: (10, True), 3: (10, True)}


def _log(spark, n=400, clients=3):
    rng, rows, ts = random.Random(4), [], 1_700_000_000
    for i in range(n):
        ts += rng.choice([0, 5, 40, 900, 4000])
        status = rng.choice([200, 200, 404, 429, 429, 403, 500, 0])
        rows.append((i, ts, "a" if rng.random() < 0.5 else f"c{rng.randrange(clients)}", status, rng.choice([None, None, 10.0, 500.0]) if status == 429 else None))
    frame = spark.createDataFrame(rows, "request_id long, s long, client string, status int, retry_after_s double")
    return rows, frame.select("request_id", F.timestamp_seconds("s").alias("ts"), "client", "status", F.col("status").isin(0, 403, 407, 429).alias("failure"), "retry_after_s")


def test_backoff_and_streaks_equal_a_walk(spark):
    rows, frame = _log(spark)
    state, want = {}, {}
    for rid, _, client, status, retry in rows:
        backoff, streak = state.get(client, (0.0, 0))
        if status == 429 and retry is not None:
            backoff = min(retry, 90.0)
        elif status in (429, 403, 407, 0):
            backoff = min(90.0, max(backoff * 2, 2.0))
        elif status >= 500:
            backoff = min(90.0, max(backoff * 1.5, 2.0))
        elif status < 400:
            backoff = 0.0
        if status in (0, 403, 407, 429):
            streak += 1
        elif 200 <= status < 400:
            streak = 0
        state[client] = (backoff, streak)
        want[rid] = (round(backoff, 6), streak)
    limits = {"default": (1, 1, 2.0, 90.0)}
    got = {r.request_id: round(r.backoff_s, 6) for r in requestlog.backoff_state(frame, limits, key="client").collect()}
    streaks = {r.request_id: r.streak for r in requestlog.failure_streaks(frame).collect()}
    assert {k: (got[k], streaks[k]) for k in got} == want


def test_running_values_do_not_depend_on_the_chunk(spark):
    _, frame = _log(spark)
    results = []
    for unit in ("minute", "day", "year"):
        out = ordered.running_since_reset(frame, ["client"], ["ts", "request_id"], F.date_trunc(unit, "ts"), {"n": F.lit(1)}, F.col("status") == 200)
        results.append({(r.request_id, r.n) for r in out.collect()})
    assert results[0] == results[1] == results[2]


def test_a_busy_client_in_one_hour_is_many_chunks(spark):
    rng = random.Random(12)
    rows = [(i, 7200 + rng.randrange(3600) if i % 3 else rng.randrange(10**6), "hot" if i % 3 else f"c{rng.randrange(40)}", rng.choice([200, 403, 429, 500, 404])) for i in range(6000)]
    log = spark.createDataFrame(rows, "request_id long, s long, client string, status int").withColumn("ts", F.timestamp_seconds("s"))
    log = log.withColumns({"failure": F.col("status").isin(403, 429), "retry_after_s": F.lit(None).cast("double")})
    parts = ordered.with_parts(log, ["client"], "ts", 100)
    sizes = [r["count"] for r in parts.filter("client = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 39 and max(sizes) <= 100 + 12  # a chunk ends with a whole second
    assert parts.filter("client <> 'hot'").agg(F.max("_part")).first()[0] == 0
    limits = {"default": (1, 1, 2.0, 90.0)}
    for run in (
        lambda n: requestlog.failure_streaks(log, chunk_rows=n).select("request_id", "streak"),
        lambda n: requestlog.backoff_state(log, limits, "client", n).select("request_id", F.round("backoff_s", 6)),
        lambda n: requestlog.request_gaps(log, limits, "client", n).select("request_id", "gap_s"),
        lambda n: requestlog.sliding_rate(log, chunk_rows=n).select("request_id", "recent"),
        lambda n: requestlog.sliding_rate(log, seconds=900, chunk_rows=n).select("request_id", "recent"),
    ):
        assert {tuple(r) for r in run(100).collect()} == {tuple(r) for r in run(10**6).collect()}


def test_sliding_rate_across_hours(spark):
    rows = [(1, 3590), (2, 3595), (3, 3601), (4, 3655), (5, 3656), (6, 7300)]
    frame = spark.createDataFrame([(i, s, "a") for i, s in rows], "request_id long, s long, client string").select("request_id", "client", F.timestamp_seconds("s").alias("ts"))
    got = {r.request_id: (r.recent, r.over_limit) for r in requestlog.sliding_rate(frame, limit=2).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, True), 4: (2, False), 5: (3, True), 6: (1, False)}


def test_nearest_equals_brute_force_on_uneven_data(spark):
    rng = random.Random(2)
    spots = [(i, 41.0, 29.0) for i in range(60)] + [(100 + i, rng.uniform(-60, 70), rng.uniform(-170, 170)) for i in range(60)]
    points = [(i, rng.uniform(-60, 70), rng.uniform(-170, 170)) for i in range(25)] + [(90, 41.001, 29.001)]
    v = spark.createDataFrame(spots, "restaurant_id long, lat double, lng double")
    p = spark.createDataFrame(points, "point_id long, lat double, lng double")
    got = {(r.point_id, r["rank"]): r.distance_km for r in places.nearest(p, v, 3).collect()}
    for pid, lat, lng in points:
        best = [r.distance_km for r in places.nearest_to_point(v, lat, lng, 3).collect()]
        assert [got[(pid, k)] for k in (1, 2, 3)] == pytest.approx(best)


def test_nearest_across_the_antimeridian_and_at_the_poles(spark):
    v = spark.createDataFrame([(1, 0.0, -179.9995), (2, 0.0, 178.0), (3, 89.99, 10.0), (4, 89.99, -170.0), (5, -89.9, 0.0), (6, 80.0, 100.0)], "restaurant_id long, lat double, lng double")
    asked = [(1, 0.001, 179.9995), (2, 89.995, 100.0), (3, -90.0, 77.0), (4, 90.0, 0.0), (5, 0.0, 180.0), (6, 0.0, -180.0)]
    p = spark.createDataFrame(asked, "point_id long, lat double, lng double")
    got = {(r.point_id, r["rank"]): (r.restaurant_id, r.distance_km) for r in places.nearest(p, v, 3).collect()}
    assert got[(1, 1)][0] == 1 and got[(1, 1)][1] < 0.16
    for pid, lat, lng in asked:
        best = places.nearest_to_point(v, lat, lng, 3).collect()
        assert [got[(pid, i)][1] for i in (1, 2, 3)] == pytest.approx([r.distance_km for r in best], abs=1e-9)


def test_dishes_are_looked_up_by_their_canonical_names(spark):
    dishes = spark.createDataFrame([(1, "Acılı dürüm", "Adana Kebap", "acili-durum"), (2, "Ayran", None, "ayran"), (3, "Boza", None, "boza")], "dish_id long, name string, canonical_name string, slug string")
    scores = spark.createDataFrame([(7, "adana kebap", 8.5, 4), (8, "Adana Kebap", 9.0, 2), (7, "ayran", 6.0, 3)], "restaurant_id long, food string, score double, review_count long")
    venues = spark.createDataFrame([(7, "Deniz", "deniz", "Kadikoy", True), (8, "Koy", "koy", None, True)], "restaurant_id long, name string, slug string, district string, is_active boolean")
    mentions = spark.createDataFrame([("ADANA KEBAP", "positive"), ("adana kebap", "negative"), ("ayran", "neutral")], "food string, sentiment string")
    got = {r.slug: r for r in detail.dish_documents(dishes, scores, venues, mentions).collect()}
    durum = got["acili-durum"]
    assert [(v.venue, v.score) for v in durum.venues] == [("Koy", 9.0), ("Deniz", 8.5)] and durum.stats.avg_score == 8.75
    assert tuple(durum.sentiment) == (2, 1, 1, 0) and got["ayran"].sentiment.neutral == 1
    assert got["boza"].venues is None and (got["boza"].stats.venue_count, got["boza"].sentiment.total) == (0, 0)
    counts = {r.dish_id: r.restaurant_count for r in search.dish_venue_counts(dishes, scores).collect()}
    assert counts == {1: 2, 2: 1, 3: 0}
    assert [r.dish_id for r in detail.dish_by_slug(dishes, "ayran").collect()] == [2] and detail.dish_by_slug(dishes, "x").isEmpty()


def test_lexeme_search_and_stemming(spark):
    docs = spark.createDataFrame([(1, "Çiya Sofrası Kadıköy"), (2, "Kebapçılar Çarşısı"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ciya KADIKOY"), (2, "kebapci"), (3, "ve")], "query_id long, query string")
    assert {tuple(r) for r in search.lexeme_search(asked, docs).collect()} == {(1, 1)}
    assert (2, 2) in {tuple(r) for r in search.lexeme_search(asked, docs, search.light_stemmer).collect()}


PAGE = """<html><body><div class="gws-localreviews__google-review" data-review-id="r1"><div class="TSUbDb"><a href="/u/1">Ada</a></div>
<span class="lTi8oc" aria-label="Rated 4.0 out of 5.0"></span><span class="dehysf">2 hafta önce</span>
<span class="review-full-text">Çok &amp;amp; güzel <b>x</b> yemek</span><div class="d6SCIc">Teşekkürler</div><span class="GBkF3d">1.2K</span><button class="Tya61d"></button></div>
<div class="gws-localreviews__google-review"><span class="elGi1d"></span><span class="elGi1d"></span><p>Uzun bir yorum metni burada</p><p>kısa</p></div>
<div class="gws-localreviews__google-review"><span>x</span></div></body></html>"""


def test_review_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<div class='WMbnJf'><span class='wiI7pd'>Tek blok yorumu</span></div>"), (3, None)], "page_id long, html string")
    got = {(r.page_id, r.block_no): r for r in extract_html.extract_reviews(pages, F.timestamp_seconds(F.lit(1_700_000_000))).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    first = got[(1, 0)]
    assert (first.review_id, first.author, first.author_url, first.rating, first.likes, first.photos) == ("r1", "Ada", "/u/1", 4, 1200, 1)
    assert first.text == "Çok & güzel yemek" and first.owner_reply == "Teşekkürler"
    assert got[(1, 1)].rating == 2 and got[(1, 1)].text == "Uzun bir yorum metni burada" and len(got[(1, 1)].review_id) == 16
