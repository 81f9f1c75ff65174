"""Sharding by rendezvous hashing over weighted shards.

Each pair of record key and shard number draws a uniform number u from a hash; the record goes to the shard of the
smallest -ln(u) / weight.  Shards then get keys in proportion to their weights, and the choice depends on nothing but
the key and the shards' weights: one more shard (or a larger weight) takes keys only into itself, one shard less gives
away only its own.  No state is kept and no row is moved to decide.

Slots number the rows of a shard from 0 without gaps, in the order of another hash of the key (then of the tie columns),
so that they do not depend on files or partitions.  Rows are dealt by ranges of that order, also where one shard, key
or repeated row holds most of them; only the counts per range and shard are added up.

A null key is a key of its own; rows of equal key share a shard, whatever their number; repeated rows get slots of their
own; a shard of weight 0 or less gets nothing; null and empty texts have size 1 and checksum 0; an empty table stays
empty.  Extra columns pass through; names used inside give way to those of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sofralytics.llm.common import fresh, saved
from sofralytics.llm.mixing import uniform

SEED = 13


def shard_of(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The number of the shard that a key goes to; null where no shard has a weight."""
    shards = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not shards:
        return F.lit(None).cast("int")
    held = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in shards])
    costs = F.transform(held, lambda s: F.struct((-F.ln(uniform(F.lit(seed), key, s["shard"])) / s["weight"]).alias("cost"), s["shard"].alias("shard")))
    return F.array_min(costs)["shard"]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus one."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("bigint")


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("bigint")


def assigned(rows: DataFrame, key: str, weights: Sequence[float], seed: int = SEED) -> DataFrame:
    """The rows with their ``shard``; a column of that name is replaced.  One projection, nothing is shuffled."""
    return rows.withColumn("shard", shard_of(F.col(key), weights, seed))


def moved(rows: DataFrame, key: str, before: Sequence[float], after: Sequence[float], seed: int = SEED) -> DataFrame:
    """The rows that change their shard between two lists of weights, with ``shard`` and ``new_shard``."""
    both = assigned(rows, key, before, seed).withColumn("new_shard", shard_of(F.col(key), after, seed))
    return both.where(~F.col("shard").eqNullSafe(F.col("new_shard")))


def slots(rows: DataFrame, key: str, ties: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """The rows (with ``shard``) and their ``slot``.

    Rows are written, dealt by ranges and written again in order, each with its place in its range.  The counts have one
    row for each range and one more for each shard; with them a place becomes a slot.
    """
    draw, row, place, part, first, start = (fresh(rows, f"_{n}") for n in ("draw", "row", "place", "part", "first", "start"))
    order = ["shard", draw, key, *ties, row]
    staged = rows.withColumn(draw, uniform(F.lit(seed), F.lit("slot"), F.col(key))).withColumn(row, F.monotonically_increasing_id())
    dealt = saved(staged, "sharded").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = saved(dealt.withColumn(place, F.monotonically_increasing_id()), "ordered").withColumn(part, F.shiftright(place, 33))
    counts = ordered.groupBy("shard", part).agg(F.min(place).alias(first), F.count("*").alias(start))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    names = [F.col(c).alias(fresh(ordered, f"_of_{c}")) for c in ("shard", part)]
    counts = counts.select(*names, first, start)
    shard, range_of = counts.columns[:2]
    found = ordered.join(F.broadcast(counts), F.col("shard").eqNullSafe(F.col(shard)) & (F.col(part) == F.col(range_of)))
    return found.withColumn("slot", F.col(start) + F.col(place) - F.col(first)).select(*[c for c in rows.columns if c != "slot"], "slot")


def write(docs: DataFrame, path: str, key: str, weights: Sequence[float], seed: int = SEED) -> None:
    """Write the rows as Parquet under one folder a shard, those of a file in hashed order; a large shard gets many files."""
    placed = assigned(docs, key, weights, seed)
    draw = fresh(placed, "_draw")
    placed = placed.withColumn(draw, uniform(F.lit(seed), F.lit("slot"), F.col(key), F.xxhash64(*docs.columns)))
    placed.repartitionByRange("shard", draw).sortWithinPartitions("shard", draw).drop(draw).write.partitionBy("shard").parquet(path)
