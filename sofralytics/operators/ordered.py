"""Running values per key that do not need a whole key in one task.

A window partitioned by key alone puts all rows of a busy key into one task.  Here every key is cut into
chunks of bounded rows (``with_parts``): values run inside each (key, chunk), each chunk is summarised to one row,
the summaries are combined per key, and the carried-in value is joined back on (key, chunk).  The large
side is shuffled once; the window and the join share its partitioning.  Keys and chunk must not be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK, PART, STARTS = "_chunk", "_part", "_starts"
CHUNK_ROWS = 1_000_000


def chunk_starts(rows: DataFrame, keys, time: str, chunk_rows: int) -> DataFrame:
    """(keys, starts): the seconds at which a key's second and later chunks of about ``chunk_rows`` rows begin.

    Rows are counted by second, counts are summed up within days, and days are chained.  Only keys of more than one chunk
    are returned, one number for each ``chunk_rows`` rows of the log.  A chunk is larger only by the rows of its last second.
    """
    second = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000).alias("s")
    counted = rows.groupBy(*keys, second).agg(F.count("*").alias("n")).withColumn("d", F.floor(F.col("s") / 86_400))
    inside = Window.partitionBy(*keys, "d").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    days = counted.groupBy(*keys, "d").agg(F.sum("n").alias("n")).withColumn("days_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = counted.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(days, [*keys, "d"])
    number = F.floor((F.col("before") + F.col("days_before")) / chunk_rows).alias("c")
    firsts = placed.groupBy(*keys, number).agg(F.min("s").alias("s")).filter("c > 0")
    return firsts.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias(STARTS))


def with_starts(rows: DataFrame, keys, time: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows with their key's ``chunk_starts`` (empty for most keys)."""
    starts = chunk_starts(rows, keys, time, chunk_rows)  # bounded: a number for each chunk_rows rows
    return rows.join(F.broadcast(starts), list(keys), "left").withColumn(STARTS, F.coalesce(STARTS, F.array().cast("array<bigint>"))).select(*rows.columns, STARTS)


def chunk_at(second: Column) -> Column:
    """The number of the chunk that holds a second."""
    return F.size(F.filter(STARTS, lambda s: s <= second))


def with_parts(rows: DataFrame, keys, time: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows with ``_part``, the number of their chunk within the key; equal seconds share a chunk."""
    second = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000)
    return with_starts(rows, keys, time, chunk_rows).withColumn(PART, chunk_at(second)).drop(STARTS)


def _local(keys, order) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_since_reset(rows: DataFrame, keys, order, chunk: Column, values: dict[str, Column], reset: Column) -> DataFrame:
    """For every row and value: its sum over the rows after the latest reset row, up to this row.

    The reset row itself starts again at 0.
    """
    base = rows.withColumn(CHUNK, chunk).withColumn("_reset", F.coalesce(reset, F.lit(False)))
    for name, value in values.items():
        base = base.withColumn(name, F.when(F.col("_reset"), F.lit(0)).otherwise(F.coalesce(value, F.lit(0))).cast("long"))
    window = _local(keys, order)
    # Sum so far minus the sum at the latest reset; sums never fall, so "at the latest reset" is a running maximum.
    summed = {f"_s_{n}": F.sum(n).over(window) for n in values}
    local = base.withColumns(summed).withColumn("_seen", F.max(F.col("_reset").cast("int")).over(window))
    local = local.withColumns({f"_at_{n}": F.max(F.when(F.col("_reset"), F.col(f"_s_{n}"))).over(window) for n in values})
    summary = local.groupBy(*keys, CHUNK).agg(
        F.max("_seen").alias("_has"),
        *[F.max(f"_s_{n}").alias(f"_t_{n}") for n in values],
        *[F.max(F.coalesce(F.col(f"_at_{n}"), F.lit(0))).alias(f"_r_{n}") for n in values],
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    for n in values:
        total = F.sum(f"_t_{n}").over(through)
        summary = summary.withColumn(f"_cum_{n}", total)
        at_reset = F.when(F.col("_has") == 1, F.col(f"_cum_{n}") - F.col(f"_t_{n}") + F.col(f"_r_{n}"))
        summary = summary.withColumn(f"_mark_{n}", at_reset)
        carried = F.coalesce(F.max(f"_cum_{n}").over(before), F.lit(0)) - F.coalesce(F.max(f"_mark_{n}").over(before), F.lit(0))
        summary = summary.withColumn(f"_in_{n}", carried)
    carry = summary.select(*keys, CHUNK, *[f"_in_{n}" for n in values])
    joined = local.join(carry, [*keys, CHUNK])
    out = {
        n: F.when(F.col("_seen") == 1, F.col(f"_s_{n}") - F.col(f"_at_{n}")).otherwise(F.col(f"_s_{n}") + F.col(f"_in_{n}")).cast("long")
        for n in values
    }
    return joined.select(*[c for c in rows.columns if c not in values], *[c.alias(n) for n, c in out.items()])


def carry_last(rows: DataFrame, keys, order, chunk: Column, columns: dict[str, Column], include_current: bool = True) -> DataFrame:
    """The latest non-NULL value of each column at (or, without the current row, before) every row."""
    base = rows.withColumn(CHUNK, chunk).withColumns({f"_v_{n}": c for n, c in columns.items()})
    end = 0 if include_current else -1
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = base.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(window) for n in columns})
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    summary = base.groupBy(*keys, CHUNK).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in columns]
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, CHUNK, *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in columns])
    joined = local.join(carry, [*keys, CHUNK])
    return joined.select(*rows.columns, *[F.coalesce(f"_l_{n}", f"_in_{n}").alias(n) for n in columns])
