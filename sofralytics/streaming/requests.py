"""Streaming rules over request logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sofralytics.functions import fixed_values as fv


def timed(log: DataFrame, lateness: str) -> DataFrame:
    """The log with a watermark; the time column must be a zoned timestamp."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def hourly_use(log: DataFrame, key: str = "platform", lateness: str = "10 minutes") -> DataFrame:
    """Requests per key and hour, emitted once an hour can receive no more rows."""
    return (
        timed(log, lateness)
        .groupBy(F.window("ts", "1 hour").alias("w"), key)
        .agg(F.count("*").alias("requests"))
        .select(key, F.col("w.start").alias("period"), "requests")
    )


def sliding_use(log: DataFrame, key: str = "client", lateness: str = "1 minute", limit: int = fv.CLIENT_RATE_PER_MINUTE) -> DataFrame:
    """Requests per key in 60-second windows that start every 10 seconds, and whether over the limit."""
    return (
        timed(log, lateness)
        .groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), key)
        .agg(F.count("*").alias("requests"))
        .select(key, F.col("w.start").alias("start"), "requests", (F.col("requests") > limit).alias("over_limit"))
    )


HEALTH_OUT = "client string, request_id bigint, backoff_s double, streak bigint, blacklisted boolean"
# ``waiting`` holds the rows that may still be overtaken, as JSON in time order.
HEALTH_STATE = "backoff_s double, streak bigint, last_ms bigint, waiting string"


def next_health(backoff: float, streak: int, status: int, failed: bool, retry: float | None, delay_s: float, cap_s: float) -> tuple[float, int]:
    """Backoff and streak after one response."""
    success = 200 <= status < 400
    if status == 429 and retry is not None:
        backoff = min(retry, cap_s)
    elif status in (0, 403, 407, 429):
        backoff = min(max(backoff * 2, delay_s), cap_s)
    elif success:
        backoff = 0.0
    elif status >= 500:
        backoff = min(max(backoff * 1.5, delay_s), cap_s)
    if failed:
        streak += 1
    elif success:
        streak = 0
    return backoff, streak


def client_health(
    log: DataFrame, delay_s: float, cap_s: float, threshold: int = fv.FAILURES_TO_BLACKLIST, lateness: str = "10 minutes", idle_s: int = 86_400
) -> DataFrame:
    """Backoff and failure streak of every client after each response, in time order however the rows arrive.

    A row waits in the client's state until the watermark has passed it; then no earlier row can come, and it is applied.
    A timer of the earliest waiting row wakes the client up when no row of its own does.  A client without rows for
    ``idle_s`` seconds is forgotten: it starts again at no backoff and no streak.  Rows later than ``lateness`` are dropped
    by the watermark.  State per client: two numbers and the rows of one lateness.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        backoff, streak, last_ms, waiting = state.get if state.exists else (0.0, 0, 0, "[]")
        rows, passed = json.loads(waiting), state.getCurrentWatermarkMs()
        for chunk in chunks:
            micros = chunk["ts"].astype("datetime64[us]").astype("int64")
            retries = [None if r is None or r != r else float(r) for r in chunk["retry_after_s"]]
            rows += [[int(t), int(i), int(s), bool(f), r] for t, i, s, f, r in zip(micros, chunk["request_id"], chunk["status"], chunk["failure"], retries)]
        rows.sort(key=lambda r: r[:2])
        ready = 0
        out = []
        for ts, request, status, failed, retry in rows:
            if ts // 1000 >= passed:
                break
            if last_ms and ts // 1000 - last_ms >= idle_s * 1000:
                backoff, streak = 0.0, 0
            backoff, streak = next_health(backoff, streak, status, failed, retry, delay_s, cap_s)
            out.append((key[0], request, backoff, streak, streak >= threshold))
            ready, last_ms = ready + 1, ts // 1000
        left = rows[ready:]
        # Woken after the earliest waiting row, or when the client has been idle for long.
        wake = left[0][0] // 1000 + 1 if left else last_ms + idle_s * 1000
        if not left and wake <= passed:
            state.remove()
        else:
            state.update((backoff, streak, last_ms, json.dumps(left)))
            state.setTimeoutTimestamp(max(wake, passed + 1))
        if out:
            yield pd.DataFrame(out, columns=["client", "request_id", "backoff_s", "streak", "blacklisted"])

    columns = ["client", "request_id", "ts", "status", "failure", "retry_after_s"]
    return timed(log.select(*columns), lateness).groupBy("client").applyInPandasWithState(step, HEALTH_OUT, HEALTH_STATE, "append", GroupStateTimeout.EventTimeTimeout)
