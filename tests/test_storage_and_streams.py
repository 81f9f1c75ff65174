import json

import pytest
from pyspark.sql import functions as F

from sofralytics import schemas
from sofralytics.operators import requestlog, scoring, upsert
from sofralytics.plans import jobs
from sofralytics.sources import feeds, tables, versions
from sofralytics.streaming import incremental, requests


def test_feed_and_dictionary(spark, folder):
    rows = spark.createDataFrame([("g", "e1", "r1", "Ada", "5", "Harika yer", None, None, None, None, 1)], schemas.BRONZE_REVIEW)
    feeds.write_feed(rows, f"{folder}/feed")
    assert feeds.read_feed(spark, f"{folder}/feed", "reviews").first()["text"] == "Harika yer"
    with open(f"{folder}/dishes.json", "w", encoding="utf-8") as f:
        json.dump([{"canonical": "Pide", "aliases": ["lahmacun"], "category": "pide", "region": None}, {"canonical": ""}], f)
    entries = feeds.read_dish_dictionary(spark, f"{folder}/dishes.json")
    assert [(r.canonical, r.aliases) for r in entries.collect()] == [("Pide", ["lahmacun"])]
    with open(f"{folder}/lists.json", "w", encoding="utf-8") as f:
        json.dump({"icecek": ["çay"], "yan_urun": ["peçete"], "yemek_kategorileri": {"a": "b"}}, f)
    assert {tuple(r) for r in feeds.read_filter_lists(spark, f"{folder}/lists.json").collect()} == {("icecek", "çay"), ("yan_urun", "peçete")}
    with open(f"{folder}/page.html", "w", encoding="utf-8") as f:
        f.write("<p>ç</p>")
    assert feeds.read_pages(spark, folder, "html").first()["html"] == "<p>ç</p>"


def test_ledger_counts_and_failures(spark, folder):
    frame = spark.range(10).withColumn("bad", F.col("id") > 7)
    counts = tables.run_with_ledger(spark, "copy", frame, lambda d: d.write.parquet(f"{folder}/out"), f"{folder}/ledger", F.col("bad"))
    assert counts == {"rows_written": 10, "rows_rejected": 2}
    with pytest.raises(Exception):
        tables.run_with_ledger(spark, "copy", frame, lambda d: d.write.parquet(f"{folder}/out"), f"{folder}/ledger")
    assert sorted(r.status for r in spark.read.parquet(f"{folder}/ledger").collect()) == ["completed", "failed"]


def test_append_mentions_and_done_ids(spark, folder):
    rows = spark.createDataFrame([(1, "adana", "Adana Kebap", 1.0, True)], "review_id long, food_name string, canonical_name string, confidence double, is_food boolean")
    tables.append_mentions(rows, f"{folder}/m")
    tables.append_mentions(rows, f"{folder}/m")
    stored = tables.read_table(spark, f"{folder}/m", "food_mentions")
    assert stored.count() == 2 and stored.schema == schemas.TABLES["food_mentions"]
    tables.mark_done(rows, f"{folder}/done")
    reviews = spark.createDataFrame([(1,), (2,)], "review_id long")
    assert [r.review_id for r in tables.still_open(reviews, spark.read.parquet(f"{folder}/done")).collect()] == [2]


def _write(frame, folder, number):
    frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/part={number}")


def test_running_scores_equal_batch_scores_and_resume(spark, tables, folder):
    mentions = tables.mentions_v.select("restaurant_id", "food", "sentiment", "confidence", "star_rating", "mention_no")
    schema = mentions.schema
    for part in range(2):
        _write(mentions.filter(F.col("mention_no") % 3 == part), folder, part)
    run = lambda: incremental.drain(
        incremental.file_stream(spark, f"{folder}/in/*", schema, files_per_batch=1), incremental.score_batches(f"{folder}/sums"), f"{folder}/ckpt"
    )
    run()
    _write(mentions.filter(F.col("mention_no") % 3 == 2), folder, 2)
    run()
    run()  # nothing new: no further version
    got = {tuple(r) for r in incremental.running_scores(spark, f"{folder}/sums").collect()}
    assert got == {tuple(r) for r in scoring.score_dishes(mentions).collect()}
    assert len(versions.numbers(spark, f"{folder}/sums")) == 3


def test_streamed_upsert_equals_batch(spark, folder):
    schema = "slug string, name string, address string, arrival long"
    steps = [[("a", "A", "x", 1), ("b", "B", None, 2)], [("a", "A2", None, 3), ("c", "C", "z", 4)]]
    empty = spark.createDataFrame([], "slug string, name string, address string")
    frames = [spark.createDataFrame(rows, schema) for rows in steps]
    for i, frame in enumerate(frames):
        _write(frame, folder, i)
        incremental.drain(
            incremental.file_stream(spark, f"{folder}/in/*", frames[0].schema, files_per_batch=1),
            incremental.upsert_batches(f"{folder}/venues", upsert.upsert_venues, empty), f"{folder}/ckpt",
        )
    got = {tuple(r) for r in versions.latest(spark, f"{folder}/venues").collect()}
    assert got == {("a", "A2", "x"), ("b", "B", None), ("c", "C", "z")}
    assert got == {tuple(r) for r in upsert.upsert_venues(empty, frames[0].unionByName(frames[1])).collect()}


def test_streamed_first_seen(spark, folder):
    rows = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30)], "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    _write(rows, folder, 0)
    _write(rows.withColumn("id", F.col("id") + 10), folder, 1)
    stream = incremental.first_seen(incremental.file_stream(spark, f"{folder}/in/*", rows.schema, files_per_batch=1), ["k"], "ts")
    incremental.drain(stream, incremental.append_batches(lambda d: d.select("id", "k"), f"{folder}/out"), f"{folder}/ckpt")
    assert sorted(r.k for r in incremental.read_batches(spark, f"{folder}/out").collect()) == ["a", "b"]


def _memory(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_streamed_hours_and_windows_equal_batch(spark, tables, folder):
    log = tables.requests_v
    log.orderBy("ts").coalesce(1).write.parquet(f"{folder}/log")
    stream = incremental.file_stream(spark, f"{folder}/log", log.schema)
    hours = {(r.platform, r.period): r.requests for r in _memory(spark, requests.hourly_use(stream), "hours", "complete").collect()}
    batch = requestlog.quota_use(log.withColumn("ts", F.col("ts").cast("timestamp")), "hour")
    assert hours == {(r.platform, r.period): r.requests for r in batch.collect()}
    windows = _memory(spark, requests.sliding_use(stream, limit=1), "windows", "complete")
    assert windows.agg(F.sum("requests")).first()[0] == 6 * log.count()


def test_streamed_health_equals_batch_on_shuffled_batches(spark, tables, folder):
    log = tables.requests_v.withColumn("client", F.col("client").cast("string")).withColumn("ts", F.col("ts").cast("timestamp"))
    columns = ["request_id", "ts", "client", "status", "failure", "retry_after_s"]
    # Neighbouring rows land in different batches; the last batch ends the wait, a day and more after all others.
    for part in range(2):
        _write(log.filter(F.pmod(F.xxhash64("request_id"), F.lit(2)) == part).select(*columns), folder, part)
    end = log.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("request_id"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("end").alias("client"),
        F.lit(200).alias("status"), F.lit(False).alias("failure"), F.lit(None).cast("double").alias("retry_after_s"),
    )
    kinds = dict(log.dtypes)
    _write(end.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]), folder, 2)
    schema = spark.read.parquet(f"{folder}/in").drop("part").schema
    stream = incremental.file_stream(spark, f"{folder}/in/*", schema, files_per_batch=1)
    health = requests.client_health(stream, 2.0, 90.0, lateness="399 days", idle_s=10**9)
    query = health.writeStream.format("memory").queryName("health").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.request_id: (round(r.backoff_s, 6), r.streak) for r in spark.table("health").collect()}
    limits = {"default": (1, 1, 2.0, 90.0)}
    backoff = {r.request_id: round(r.backoff_s, 6) for r in requestlog.backoff_state(log, limits, key="client").collect()}
    streaks = {r.request_id: r.streak for r in requestlog.failure_streaks(log).collect()}
    assert got == {k: (backoff[k], streaks[k]) for k in backoff}


def test_idle_clients_leave_the_state(spark, folder):
    rows = "request_id long, s long, client string, status int, failure boolean, retry_after_s double"
    steps = [[(i, 1000 + i, f"c{i}", 429, True, None) for i in range(50)], [(100, 10_000, "late", 200, False, None)], [(101, 90_000, "late", 200, False, None), (102, 90_000, "c1", 429, True, None)], [(103, 200_000, "late", 200, False, None)]]
    totals = []
    for number, step in enumerate(steps):
        _write(spark.createDataFrame(step, rows).withColumn("ts", F.timestamp_seconds("s")), folder, number)
        schema = spark.read.parquet(f"{folder}/in").drop("part").schema
        stream = incremental.file_stream(spark, f"{folder}/in/*", schema)
        health = requests.client_health(stream, 2.0, 90.0, lateness="1 second", idle_s=3600)
        query = health.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
        query.awaitTermination()
        totals.append(max((s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p["stateOperators"]), default=None))
    assert totals[0] == 50 and totals[1] <= 1 and totals[-1] <= 2
    got = {r.request_id: (r.backoff_s, r.streak) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got[7] == (2.0, 1) and got[102] == (2.0, 1)  # c1 was idle for long: no streak of two


def test_jobs_from_bronze_to_scores(spark, tables):
    parts = jobs.clean(tables.bronze_venues_v, tables.bronze_reviews_v, F.lit("2024-06-01").cast("timestamp"))
    assert parts["reviews"].count() + parts["rejected_reviews"].count() <= tables.bronze_reviews_v.count()
    assert parts["venues"].filter("name IS NULL OR trim(name) = ''").isEmpty()
    entries = spark.createDataFrame([(0, "Adana Kebap", ["adana"], "kebap", None)], "load_position long, canonical string, aliases array<string>, category string, region string")
    reviews = spark.createDataFrame([(1, 5, "Adana kebap harika. Servis kötü.", 5), (2, 5, "adana berbat", 1)], "review_id long, restaurant_id long, text string, star_rating int")
    vectors = spark.createDataFrame([], "review_id long, embedding array<float>")
    seeds = tables.vectors_v.select("label", "embedding")
    out = jobs.process_reviews(reviews, entries, vectors, seeds)
    assert {(r.review_id, r.sentiment) for r in out["mentions"].collect()} == {(1, "positive"), (2, "negative")}
    score = out["scores"].first()
    assert (score.restaurant_id, score.food, score.review_count) == (5, "adana kebap", 2)
