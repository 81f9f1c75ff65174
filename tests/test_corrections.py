"""Cases that the first round got wrong."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sofralytics.functions import parsing, text
from sofralytics.functions.best_key import KeyIndex
from sofralytics.functions.similarity import weighted_ratio
from sofralytics.operators import places, requestlog, similar
from sofralytics.plans import load_queries, place_queries
from sofralytics.plans.adapters import VIEW_SQL, for_spark
from sofralytics.sources import versions
from sofralytics.streaming import incremental


def test_failure_streak_is_left_alone_by_other_answers(spark):
    rows = [(1, 1, 403, True), (2, 2, 403, True), (3, 3, 404, False), (4, 4, 403, True), (5, 5, 200, False), (6, 6, 500, False)]
    log = spark.createDataFrame(rows, "request_id long, t long, status int, failure boolean")
    log = log.select("request_id", F.timestamp_seconds("t").alias("ts"), F.lit("a").alias("client"), "status", "failure")
    found = {r["request_id"]: (r["streak"], r["blacklisted"]) for r in requestlog.failure_streaks(log).collect()}
    assert found == {1: (1, False), 2: (2, False), 3: (2, False), 4: (3, True), 5: (0, False), 6: (0, False)}


def test_rate_over_a_window_of_hours(spark):
    log = spark.createDataFrame([(i, 1_000_000 + i * 3600) for i in range(3)], "request_id long, t long")
    log = log.select("request_id", F.timestamp_seconds("t").alias("ts"), F.lit("a").alias("client"))
    found = requestlog.sliding_rate(log, limit=2, seconds=3 * 3600).orderBy("request_id").collect()
    assert [r["recent"] for r in found] == [1, 2, 3]


def test_white_space_and_accents(spark):
    frame = spark.createDataFrame([("İyi.\n\nKötü.\n", "Lâhmacun Café", "\n\n x \n")], "a string, b string, c string")
    row = frame.select(text.sentences(F.col("a")), text.search_key(F.col("b")), text.language_flag(F.col("c"))).first()
    assert tuple(row) == (["İyi", "Kötü"], "lahmacun cafe", "tr")


def test_duplicates_of_hash_ids(spark):
    rows = [(-9_000_000_000_000_000_000, "Kebap Evi"), (9_000_000_000_000_000_000, "Kebap Evi"), (5, "Balik")]
    found = similar.find_duplicates(spark.createDataFrame(rows, "id long, name string")).collect()
    assert [(r["source_id"], r["target_id"]) for r in found] == [(-9_000_000_000_000_000_000, 9_000_000_000_000_000_000)]


def test_late_first_records_are_kept(spark, folder):
    handle = incremental.first_seen_batches(["k"], folder)
    for number, rows in enumerate([[("a", 100), ("a", 101)], [("b", 1), ("a", 2)], [("b", 5)]]):
        handle(spark.createDataFrame(rows, "k string, t long"), number)
    assert sorted(r["k"] for r in versions.earlier(spark, folder, 9).collect()) == ["a", "b"]


def _made_venues(spark):
    _, text = VIEW_SQL["venues_v"]
    supplier = spark.range(1, 1001).select(F.col("id").alias("s_suppkey"), F.lit("S").alias("s_name"), F.lit(1).alias("s_nationkey"))
    nation = spark.createDataFrame([(1, "N")], "n_nationkey int, n_name string")
    return spark.sql(for_spark(text), supplier=supplier, nation=nation)


def test_coordinates_are_divided_as_doubles(spark):
    """As in the SQL, where 28.60 + 350 / 1000.0 is just above 28.95 and so outside a box that ends there."""
    for r in _made_venues(spark).collect():
        k = r["restaurant_id"]
        assert (r["lat"], r["lng"]) == (40.8 + (k * 37 % 400) / 1000.0, 28.6 + (k * 53 % 550) / 1000.0)


def test_distances_tie_as_in_the_sql(spark):
    """Two venues at the same distance in decimals; binary noise, and with it the order, is that of the SQL."""
    points = spark.sql(for_spark(place_queries._POINTS), customer=spark.createDataFrame([(1087,)], "c_custkey long"))
    near = places.nearest(points, _made_venues(spark).filter("is_active"), 3).orderBy("rank").collect()
    assert [r["restaurant_id"] for r in near][1:] == [184, 984]


def test_hash_of_blank_texts_is_that_of_the_sql(spark, folder):
    texts = [None, "", " ", " \n\t　", "\x0b", "a\x0b", "\x0b a \x1c", " a b\x85", "ab"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents.write.parquet(f"{folder}/documents.parquet")
    registry = load_queries()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["review_id_hash"]).fetchall()
    got = [tuple(r) for r in registry.BUILDERS["review_id_hash"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and dict(got)[1] == "d41d8cd98f00b204"


def test_blank_review_without_id_gets_none(spark):
    rows = spark.createDataFrame([("", " "), ("", "a "), ("x", " ")], "id string, text string")
    got = rows.select(parsing.review_id_or_hash(F.col("id"), F.col("text")).alias("k")).collect()
    assert [r["k"] for r in got] == [None, "0cc175b9c0f1b6a8", "x"]


_WORDS = ["ka", "su", "kebap", "kebab", "kbap", "adana", "adanaa", "iskender", "iskendr", "mercimekcorbasi", "mercimekcorbsi", "k", "de", "xyz", "çorba", "corba"]


def _phrases(seed, n, most):
    rng = random.Random(seed)
    return [" ".join(rng.choices(_WORDS, k=rng.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [85.0, 88.0, 90.0])
def test_few_keys_equal_brute_force(threshold):
    keys = list(dict.fromkeys([*_phrases(1, 30, 3), "a" * 64, "kebap " * 9 + "adana", "a"]))
    cut = [k[:i] + k[i + 1 :] for k in keys[:20] for i in (1, len(k) // 2)]
    near = [*cut, *[f"zz{c}yy" for c in cut], "a" * 63, "b" * 70, "kebap " * 14 + "x", "dekasu", "ebap"]
    texts = sorted({" ".join(t.split()) for t in [*_phrases(2, 150, 4), *near]} - {"", *keys})
    number, score = KeyIndex(keys, threshold).best(texts)
    for t, k, s in zip(texts, number.tolist(), score.tolist()):
        best, first = max((weighted_ratio(t, key, threshold - 0.1), -i) for i, key in enumerate(keys))
        assert (k, s) == ((-first, best) if best >= threshold else (len(keys), 0.0)), t


def test_misspelt_dishes_join_no_runs_and_equal_the_joins(spark, monkeypatch):
    """With few keys no run is shuffled; the result is that of the joins, which stay for many keys."""
    names = [(f"Dish {i}", p) for i, p in enumerate(dict.fromkeys(_phrases(3, 12, 2)))]
    lookup = spark.createDataFrame([(p, d, (i, 0, 0)) for i, (d, p) in enumerate(names)], "key string, canonical string, key_order struct<a:long,b:int,c:int>")
    texts = [None, "", "___", "adana_kebap_ ve kebap", *[" ".join(_phrases(s, 3, 5)).replace("kebap su", "kebap_su") for s in range(20)]]
    reviews = spark.createDataFrame([*enumerate(texts), (None, "kebap ka")], "review_id long, text string")
    few = similar.fuzzy_mentions(reviews, lookup)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(KeyIndex, "takes", staticmethod(lambda keys, threshold: False))
    many = similar.fuzzy_mentions(reviews, lookup)
    order = lambda rows: sorted(map(str, rows))
    assert few.columns == many.columns and order(few.collect()) == order(many.collect())
