"""Size-checked choices between a broadcast and a shuffled join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of narrow lookup data that fit comfortably in every executor.
BROADCAST_ROWS = 200_000


def bounded(frame: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast when it is proven to hold at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows.  A larger frame is returned unmarked, so the join
    falls back to a shuffle that adaptive execution may still rebalance.
    """
    small = frame.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(frame) if small else frame


def spread(frame: DataFrame, bytes_per_task: int = 128 * 1024 * 1024) -> DataFrame:
    """A small input spread over all cores before heavy per-row work; a large one is left as it is.

    A few megabytes of text stored as one row group would keep a single task busy.  The plan's own
    size estimate decides, so no data is read for the check.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(cores) if estimate < cores * bytes_per_task else frame


def spread_by(frame: DataFrame, *columns: str) -> DataFrame:
    """Hash-partitioned by the columns into exactly the configured number of shuffle partitions.

    Adaptive execution merges small partitions by bytes; rows that are few but costly to process would end
    up in one task.  A stated number of partitions is kept.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(parts, *columns)
