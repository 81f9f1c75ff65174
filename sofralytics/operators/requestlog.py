"""Rules over request logs: quotas, rates, gaps, backoff, failure streaks and statistics.

``log`` rows: request_id, ts, client, platform, status (0 for a connection error), failure, wait_s,
retry_after_s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.numeric import round_to
from sofralytics.operators.ordered import CHUNK_ROWS, PART, STARTS, carry_last, chunk_at, running_since_reset, with_parts, with_starts


def _limit(platform: Column, position: int, limits: dict | None = None) -> Column:
    limits = limits or fv.PLATFORM_LIMITS
    chosen = None
    for name, values in limits.items():
        if name != "default":
            hit = platform == name
            chosen = F.when(hit, F.lit(values[position])) if chosen is None else chosen.when(hit, F.lit(values[position]))
    default = F.lit(limits["default"][position])
    return chosen.otherwise(default) if chosen is not None else default


def quota_use(log: DataFrame, unit: str, limits: dict | None = None, key: str = "platform") -> DataFrame:
    """Requests per key in each calendar ``hour`` or ``day`` against the quota."""
    position = {"day": 0, "hour": 1}[unit]
    counts = log.groupBy(key, F.date_trunc(unit, "ts").alias("period")).agg(F.count("*").alias("requests"))
    limit = _limit(F.col(key), position, limits)
    return counts.withColumns({"quota": limit.cast("long"), "over_quota": F.col("requests") > limit})


def sliding_rate(log: DataFrame, limit: int = fv.CLIENT_RATE_PER_MINUTE, seconds: int = 60, key: str = "client", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For every request: requests of the same key in the last ``seconds`` (it included), and whether over the limit.

    A row is counted from just inside the window's start up to its own moment.  Each key is cut into chunks of about
    ``chunk_rows`` rows; a row less than ``seconds`` before later chunks is also handed to these as a look-back row, so a
    busy key spreads over as many tasks as it has chunks.
    """
    span = seconds * 1_000_000
    base = with_starts(log, [key], "ts", chunk_rows).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    own = chunk_at(F.floor(F.col("_us") / 1_000_000))
    base = base.withColumns({"_own": own, "_last": chunk_at(F.floor((F.col("_us") + (span - 1)) / 1_000_000))}).drop(STARTS)
    rows = base.withColumn("_h", F.explode(F.sequence("_own", "_last")))
    window = Window.partitionBy(key, "_h").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = rows.withColumn("recent", F.count("*").over(window)).filter("_h = _own")
    return counted.select(*log.columns, "recent", (F.col("recent") > limit).alias("over_limit"))


def request_gaps(log: DataFrame, limits: dict | None = None, key: str = "platform", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Seconds since the key's previous request and how far that falls short of the minimum delay."""
    parts = with_parts(log, [key], "ts", chunk_rows)
    previous = carry_last(parts, [key], ["ts", "request_id"], F.col(PART), {"previous_ts": F.col("ts")}, include_current=False).drop(PART)
    to_us = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (to_us(F.col("ts")) - to_us(F.col("previous_ts"))) / 1_000_000.0
    delay = _limit(F.col(key), 2, limits)
    return previous.withColumns({"gap_s": gap, "shortfall_s": F.greatest(F.lit(0.0), delay - gap)}).drop("previous_ts")


def backoff_state(log: DataFrame, limits: dict | None = None, key: str = "platform", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Backoff seconds of the key after every response.

    429, 403, 407 and connection errors double it, 5xx raise it by half, both to at least the key's delay and
    at most its cap; success clears it; a Retry-After on 429 sets it.  Between two settings of the value it is
    the first raised value times 2 to the number of further doublings times 1.5 to the number of further
    half-steps, cut at the cap - so counts since the last setting are enough and no row-by-row state is needed.
    """
    status, cap = F.col("status"), _limit(F.col(key), 3, limits)
    delay = _limit(F.col(key), 2, limits)
    forced = (status == 429) & F.col("retry_after_s").isNotNull()
    success = status.between(200, 399)
    double = status.isin(0, 403, 407, 429) & ~forced
    half = status >= 500
    setting = F.coalesce(success | forced, F.lit(False))
    order, chunk = ["ts", "request_id"], F.col(PART)
    rows = running_since_reset(with_parts(log, [key], "ts", chunk_rows), [key], order, chunk, {"_doubles": double.cast("int"), "_halves": half.cast("int")}, setting)
    first = (double | half) & (F.col("_doubles") + F.col("_halves") == 1)
    rows = carry_last(
        rows, [key], order, chunk,
        {
            "_set": F.when(forced, F.least(F.col("retry_after_s"), cap)).when(success, F.lit(0.0)),
            "_first": F.when(first, F.when(double, F.lit(2.0)).otherwise(F.lit(1.5))),
        },
    )
    since = F.col("_doubles") + F.col("_halves")
    start = F.greatest(F.coalesce("_set", F.lit(0.0)) * F.col("_first"), delay)
    more_doubles = F.col("_doubles") - F.when(F.col("_first") == 2.0, 1).otherwise(0)
    more_halves = F.col("_halves") - F.when(F.col("_first") == 1.5, 1).otherwise(0)
    # Thirty doublings exceed any cap, so the powers stay finite.
    raised = start * F.pow(F.lit(2.0), F.least(more_doubles, F.lit(60))) * F.pow(F.lit(1.5), F.least(more_halves, F.lit(100)))
    value = F.when(since == 0, F.coalesce("_set", F.lit(0.0))).otherwise(F.least(cap, raised))
    return rows.withColumn("backoff_s", value).drop("_doubles", "_halves", "_set", "_first", PART)


def failure_streaks(log: DataFrame, threshold: int = fv.FAILURES_TO_BLACKLIST, key: str = "client", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Failures of the key since its last success up to every request, and whether that reaches the blacklist.

    ``failure`` marks bans (by status or text) and connection errors.  Only a status of 200-399 that is no failure
    counts as a success and starts again at 0; any other answer, a 404 or a 5xx say, leaves the streak as it is.
    """
    success = F.col("status").between(200, 399) & ~F.col("failure")
    parts = with_parts(log, [key], "ts", chunk_rows)
    rows = running_since_reset(parts, [key], ["ts", "request_id"], F.col(PART), {"streak": F.col("failure").cast("int")}, success).drop(PART)
    return rows.withColumn("blacklisted", F.col("streak") >= threshold)


def blacklist(log: DataFrame, threshold: int = fv.FAILURES_TO_BLACKLIST, key: str = "client") -> DataFrame:
    """Keys that reached the threshold, when first and their longest streak."""
    hit = F.col("blacklisted")
    return (
        failure_streaks(log, threshold, key)
        .groupBy(key)
        .agg(F.min(F.when(hit, F.col("ts"))).alias("since"), F.max("streak").alias("longest_streak"))
        .filter(F.col("since").isNotNull())
    )


def request_stats(log: DataFrame, key: str = "platform") -> DataFrame:
    """Per key: requests, total, mean and longest wait, bans, success rate."""
    ban = F.col("status").isin(*fv.BAN_STATUS_CODES)
    ok = F.col("status").between(200, 399)
    cents = F.round(F.col("wait_s") * 100).cast("long")
    return log.groupBy(key).agg(
        F.count("*").alias("requests"),
        round_to(F.sum(cents) / 100.0, 2).alias("total_wait_s"),
        round_to(F.sum(cents) / F.count("*") / 100.0, 3).alias("mean_wait_s"),
        round_to(F.max("wait_s"), 2).alias("longest_wait_s"),
        F.count_if(ban).alias("bans"),
        round_to(F.count_if(ok) / F.count("*"), 4).alias("success_rate"),
    )


def audit_requests(log: DataFrame, limits: dict | None = None) -> dict[str, DataFrame]:
    """Every rule over one log."""
    return {
        "hourly_quota": quota_use(log, "hour", limits),
        "daily_quota": quota_use(log, "day", limits),
        "client_rate": sliding_rate(log),
        "gaps": request_gaps(log, limits),
        "backoff": backoff_state(log, limits),
        "blacklist": blacklist(log),
        "stats": request_stats(log),
    }
