"""Rendezvous sharding: against a plain walk, under growth, with hot keys and odd rows."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
from pyspark.sql import functions as F

from sofralytics.llm import sharding
from sofralytics.llm.queries import QUERIES, SQL
from tools.compare import rows_of


def drawn(*parts):
    return (int(md5(":".join("~" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def plain(key, weights, seed=sharding.SEED):
    costs = [(-math.log(drawn(seed, key, i)) / w, i) for i, w in enumerate(weights) if w > 0]
    return min(costs)[1] if costs else None


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    frame = QUERIES["op13_sharding"](spark, small)
    cur = con.execute(SQL["op13_sharding"])
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_weighted_shards_equal_a_walk(spark):
    weights = [1.0, 2.5, 0.0, 4.0]
    keys = [None, *range(3000)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["shard"] for r in sharding.assigned(rows, "k", weights).collect()}
    assert got == {k: plain(k, weights) for k in keys}
    counts = Counter(got.values())
    assert counts[2] == 0
    for shard, weight in enumerate(weights):
        assert abs(counts[shard] / len(keys) - weight / sum(weights)) < 0.03
    assert sharding.assigned(rows, "k", [0.0]).where("shard IS NULL").count() == len(keys)


def test_growth_moves_only_into_the_new_shard(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    more = sharding.moved(rows, "k", [1.0] * 7, [1.0] * 8).collect()
    assert {r["new_shard"] for r in more} == {7}
    assert 0.08 < len(more) / 4000 < 0.17
    heavier = sharding.moved(rows, "k", [1.0, 1.0, 1.0], [1.0, 2.0, 1.0]).collect()
    assert {r["new_shard"] for r in heavier} == {1}
    less = sharding.moved(rows, "k", [1.0] * 4, [1.0, 0.0, 1.0, 1.0]).collect()
    assert {r["shard"] for r in less} == {1}


def test_slots_are_gapless_with_a_hot_key_and_repeated_rows(spark):
    rows = [(7 if i % 3 else i, "same" if i % 2 else f"text {i}", f"x{i % 5}") for i in range(6000)] + [(None, None, None)] * 500
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(9)
    placed = sharding.slots(sharding.assigned(frame, "doc_id", [1.0] * 4), "doc_id", ["text", "_row"])
    assert placed.columns == ["doc_id", "text", "_row", "shard", "slot"]
    found = placed.collect()
    assert Counter((r["doc_id"], r["text"], r["_row"]) for r in found) == Counter(rows)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append((r["slot"], r["doc_id"], r["text"] or "", r["_row"] or ""))
    for held in by_shard.values():
        held.sort()
        assert [h[0] for h in held] == list(range(len(held)))
        want = sorted(held, key=lambda h: (drawn(sharding.SEED, "slot", h[1]), h[2], h[3]))
        assert [h[1:] for h in held] == [h[1:] for h in want]


def test_slots_do_not_depend_on_partitions(spark, docs):
    rows = docs.select("doc_id", sharding.checksum(F.col("text")).alias("crc"))
    one, many = (sharding.slots(sharding.assigned(rows.repartition(n), "doc_id", [1.0] * 3), "doc_id", ["crc"]) for n in (1, 13))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_odd_and_empty(spark, odd):
    placed = sharding.slots(sharding.assigned(odd.withColumn("slot", F.lit("old")), "doc_id", [1.0, 1.0]), "doc_id")
    found = placed.collect()
    assert len(found) == 8 and {type(r["slot"]) for r in found} == {int}
    sized = odd.select("text", sharding.size_of(F.col("text")).alias("size"), sharding.checksum(F.col("text")).alias("crc")).collect()
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["crc"] == zlib.crc32((r["text"] or "").encode()) for r in sized)
    assert sharding.slots(sharding.assigned(odd.limit(0), "doc_id", [1.0, 1.0]), "doc_id").collect() == []


def test_written_shards_hold_every_row(spark, odd, folder):
    sharding.write(odd, f"{folder}/shards", "doc_id", [1.0] * 3)
    back = spark.read.parquet(f"{folder}/shards")
    assert sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert all(r["shard"] == plain(r["doc_id"], [1.0] * 3) for r in back.collect())
