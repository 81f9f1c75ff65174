"""The review job as a stream: equal to a batch run after stops at any point; bucketed tables rewrite what is touched."""

import os

import pytest

from sofralytics.operators import scoring, upsert
from sofralytics.plans import jobs
from sofralytics.sources.buckets import Commit, Store
from sofralytics.streaming import incremental, review_job

REVIEW = "review_id long, restaurant_id long, text string, star_rating int"
STEPS = [
    [(1, 5, "Adana kebap harika. Servis kötü.", 5), (2, 5, "adana berbat", 1), (3, 6, "ayran güzel", 4), (None, 6, "kayıp", 3)],
    [(2, 5, "adana berbat", 1), (4, 6, "Ayran ve adana kebap nefis", 5), (5, None, "ayran", 2), (6, 7, " ", 2), (7, 7, None, 2)],
    [(8, 5, "ayran harika", 5), (1, 5, "Adana kebap harika. Servis kötü.", 5)],
]


def _inputs(spark, tables):
    entries = spark.createDataFrame(
        [(0, "Adana Kebap", ["adana"], "kebap", None), (1, "Ayran", [], "icecek", None)], "load_position long, canonical string, aliases array<string>, category string, region string"
    )
    return entries, spark.createDataFrame([], "review_id long, embedding array<float>"), tables.vectors_v.select("label", "embedding")


def _arrive(spark, folder, step):
    spark.createDataFrame(STEPS[step], REVIEW).coalesce(1).write.parquet(f"{folder}/in/part={step}")


def _run(spark, folder, inputs, checkpoint="ckpt"):
    stream = incremental.file_stream(spark, f"{folder}/in/*", spark.createDataFrame([], REVIEW).schema, files_per_batch=1)
    return review_job.run_stream(stream, f"{folder}/store", f"{folder}/{checkpoint}", *inputs, buckets=4)


def _batch(spark, inputs):
    rows = {r[0]: r for step in STEPS for r in step if r[0] is not None and r[1] is not None and r[2]}
    out = jobs.process_reviews(spark.createDataFrame(list(rows.values()), REVIEW), *inputs)
    return {tuple(r) for r in out["mentions"].collect()}, {tuple(r) for r in out["scores"].collect()}


@pytest.mark.parametrize("stopped", ["quarantine", "manifest"])
def test_stream_equals_batch_after_a_stop_between_tables(spark, tables, folder, monkeypatch, stopped):
    inputs = _inputs(spark, tables)
    _arrive(spark, folder, 0)
    _run(spark, folder, inputs)
    append, finish = Commit.append, Commit.finish

    def stop(self, table, frame):
        if table == stopped:
            raise RuntimeError("stopped")
        append(self, table, frame)

    def stop_at_manifest(self):
        raise RuntimeError("stopped")

    monkeypatch.setattr(Commit, "append", stop)
    if stopped == "manifest":
        monkeypatch.setattr(Commit, "finish", stop_at_manifest)
    _arrive(spark, folder, 1)
    store = Store(spark, f"{folder}/store", 4)
    with pytest.raises(Exception, match="stopped"):
        _run(spark, folder, inputs)
    assert store.committed() == 0  # nothing of the stopped batch is visible
    monkeypatch.setattr(Commit, "append", append)
    monkeypatch.setattr(Commit, "finish", finish)
    _run(spark, folder, inputs)
    _arrive(spark, folder, 2)
    _run(spark, folder, inputs)
    _run(spark, folder, inputs, "lost")  # the checkpoint is lost: every file again, nothing counted twice

    mentions, scores = _batch(spark, inputs)
    schema = jobs.process_reviews(spark.createDataFrame([], REVIEW), *inputs)["mentions"].schema
    assert {tuple(r) for r in store.appended("mentions", schema).collect()} == mentions
    assert {tuple(r) for r in review_job.scores(spark, f"{folder}/store", buckets=4).collect()} == scores
    done = store.appended("done", spark.createDataFrame([], "review_id long").schema)
    assert sorted(r[0] for r in done.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    reasons = store.appended("quarantine", spark.createDataFrame([], REVIEW + ", reason string").schema)
    assert {(r.review_id, r.reason) for r in reasons.collect()} >= {(None, "no id"), (5, "no venue"), (7, "no text")}


def _files(folder):
    return {os.path.join(d, f)[len(folder):] for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "/n=" in d}


def test_upserts_write_touched_buckets_and_drop_old_files(spark, folder):
    empty = spark.createDataFrame([], "slug string, name string, address string")
    rows = "slug string, name string, address string, arrival long"
    root, store = f"{folder}/store", Store(spark, f"{folder}/store", 8)
    handle = review_job.bucketed_upserts(root, "venues", ["slug"], upsert.upsert_venues, empty, 8)
    handle(spark.createDataFrame([(f"v{i}", f"N{i}", None, i) for i in range(40)], rows), 0)
    first = _files(f"{root}/venues")
    bucket = store.manifest()
    assert len(bucket) == 8 and all(n == 0 for n in bucket.values())

    handle(spark.createDataFrame([("v3", "Changed", "street", 100)], rows), 1)
    second = _files(f"{root}/venues")
    touched = {k for k, n in store.manifest().items() if n == 1}
    assert len(touched) == 1 and first <= second
    assert {f.split("/")[2] for f in second - first} == {f"bucket={b}" for _, b in touched}  # only the touched bucket is new

    handle(spark.createDataFrame([("v3", None, "other", 101)], rows), 2)
    handle(spark.createDataFrame([("new", "New", None, 102)], rows), 3)
    now = _files(f"{root}/venues")
    old = {f for f in first if f.split("/")[2] in {f"bucket={b}" for _, b in touched}}
    assert old and not (old & now)  # replaced twice: gone
    assert first - old <= now

    handle(spark.createDataFrame([("v3", "Again", None, 1)], rows), 1)  # a lost checkpoint: batch 1 once more
    got = {tuple(r) for r in store.read("venues", empty.schema).collect()}
    assert got == {(f"v{i}", None if i == 3 else f"N{i}", "other" if i == 3 else None) for i in range(40)} | {("new", "New", None)}


def test_bucketed_sums_equal_batch_scores(spark, tables, folder):
    mentions = tables.mentions_v.select("restaurant_id", "food", "sentiment", "confidence", "star_rating", "mention_no")
    handle = review_job.bucketed_sums(f"{folder}/store", 4)
    for number in range(3):
        handle(mentions.filter(f"mention_no % 3 = {number}"), number)
    handle(mentions.filter("mention_no % 3 = 1"), 1)  # seen before
    kind = dict(mentions.dtypes)["restaurant_id"]
    got = {tuple(r) for r in review_job.scores(spark, f"{folder}/store", kind, 4).collect()}
    assert got == {tuple(r) for r in scoring.score_dishes(mentions).collect()}
