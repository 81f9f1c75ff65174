"""Request log rules over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.functions.numeric import round_to
from sofralytics.operators import requestlog as rl
from sofralytics.plans.registry import query, rounded

# Limits of the event types (day, hour, delay, cap), low enough that the driver's log breaks them.
LIMITS = {
    "view": (100, 5, 30.0, 120.0), "click": (60, 4, 60.0, 60.0), "error": (50, 3, 20.0, 90.0),
    "default": (70, 4, 45.0, 90.0),
}


def _limit_sql(position: int, kind: str, key: str = "platform") -> str:
    cases = " ".join(f"WHEN '{n}' THEN {v[position]}" for n, v in LIMITS.items() if n != "default")
    return f"CAST(CASE {key} {cases} ELSE {LIMITS['default'][position]} END AS {kind})"


def _quota(unit: str, position: int) -> str:
    q = _limit_sql(position, "BIGINT")
    return f"""SELECT platform, CAST(epoch(period) AS BIGINT) AS period_s, n AS requests, {q} AS quota, n > {q} AS over_quota
        FROM (SELECT platform, date_trunc('{unit}', ts) AS period, count(*) AS n FROM requests_v GROUP BY 1, 2)"""


def _with_seconds(frame):
    return frame.select("platform", F.unix_timestamp(F.col("period").cast("timestamp")).alias("period_s"), "requests", "quota", "over_quota")


@query("hourly_quota", "requests_v", sql=_quota("hour", 1))
def hourly_quota(t):
    return _with_seconds(rl.quota_use(t.requests_v, "hour", LIMITS))


@query("daily_quota", "requests_v", sql=_quota("day", 0))
def daily_quota(t):
    return _with_seconds(rl.quota_use(t.requests_v, "day", LIMITS))


@query(
    "sliding_client_rate",
    "requests_v",
    sql="""SELECT request_id, client, recent, recent > 2 AS over_limit FROM (SELECT request_id, client, count(*) OVER (
             PARTITION BY client ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent
           FROM (SELECT request_id, client, epoch_us(ts) AS us FROM requests_v))""",
)
def sliding_client_rate(t):
    """Requests of each client in the trailing hour; the log is too sparse for a minute to hold two."""
    return rl.sliding_rate(t.requests_v, limit=2, seconds=3600).select("request_id", "client", "recent", "over_limit")


@query(
    "sliding_platform_rate",
    "requests_v",
    sql="""SELECT request_id, recent, recent > 1 AS over_limit FROM (SELECT request_id, count(*) OVER (
             PARTITION BY platform ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent
           FROM (SELECT request_id, platform, epoch_us(ts) AS us FROM requests_v))""",
)
def sliding_platform_rate(t):
    return rl.sliding_rate(t.requests_v, limit=1, seconds=60, key="platform").select("request_id", "recent", "over_limit")


@query(
    "request_gaps",
    "requests_v",
    sql=f"""SELECT request_id, {rounded('gap', 6)} AS gap_s,
             CASE WHEN gap IS NULL THEN 0.0::DOUBLE ELSE {rounded(f"greatest(0.0, {_limit_sql(2, 'DOUBLE')} - gap)", 6)} END AS shortfall_s FROM (
             SELECT request_id, platform, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY platform ORDER BY ts, request_id))) / 1000000.0::DOUBLE AS gap FROM requests_v)""",
)
def request_gaps(t):
    out = rl.request_gaps(t.requests_v, LIMITS)
    return out.select("request_id", round_to(F.col("gap_s"), 6).alias("gap_s"), round_to(F.col("shortfall_s"), 6).alias("shortfall_s"))


_STEP = """CASE WHEN r.status BETWEEN 200 AND 399 THEN 0.0 WHEN r.status = 429 AND r.retry_after_s IS NOT NULL THEN least(r.retry_after_s, 90.0)
    WHEN r.status IN (0, 403, 407, 429) THEN least(90.0, greatest({p} * 2, 45.0)) WHEN r.status >= 500 THEN least(90.0, greatest({p} * 1.5, 45.0)) ELSE {p} END::DOUBLE"""


@query(
    "backoff_state",
    "requests_v",
    recursive=True,
    sql=f""", o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS rn FROM requests_v),
           walk(client, rn, request_id, b) AS (
             SELECT r.client, r.rn, r.request_id, {_STEP.format(p='0.0::DOUBLE')} FROM o r WHERE rn = 1
             UNION ALL
             SELECT r.client, r.rn, r.request_id, {_STEP.format(p='w.b')} FROM walk w JOIN o r ON r.client = w.client AND r.rn = w.rn + 1)
           SELECT request_id, {rounded('b', 6)} AS backoff_s FROM walk""",
)
def backoff_state(t):
    limits = {"default": (70, 4, 45.0, 90.0)}
    return rl.backoff_state(t.requests_v, limits, key="client").select("request_id", round_to(F.col("backoff_s"), 6).alias("backoff_s"))


_STREAK = """streaks AS (SELECT request_id, client, ts, CAST(sum(CASE WHEN failure THEN 1 ELSE 0 END) OVER (PARTITION BY client, g ORDER BY ts, request_id) AS BIGINT) AS streak
    FROM (SELECT *, sum(CASE WHEN status BETWEEN 200 AND 399 AND NOT failure THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY ts, request_id) AS g FROM requests_v))"""


@query("failure_streaks", "requests_v", sql=f", {_STREAK} SELECT request_id, streak, streak >= 3 AS blacklisted FROM streaks")
def failure_streaks(t):
    return rl.failure_streaks(t.requests_v).select("request_id", "streak", "blacklisted")


@query(
    "client_blacklist",
    "requests_v",
    sql=f", {_STREAK} SELECT client, epoch_us(min(ts) FILTER (WHERE streak >= 3)) AS since_us, max(streak) AS longest_streak FROM streaks GROUP BY client HAVING max(streak) >= 3",
)
def client_blacklist(t):
    return rl.blacklist(t.requests_v).select("client", F.unix_micros(F.col("since").cast("timestamp")).alias("since_us"), "longest_streak")


@query(
    "request_stats",
    "requests_v",
    sql=f"""SELECT platform, count(*) AS requests, {rounded('sum(wait_s)', 2)} AS total_wait_s, {rounded('avg(wait_s)', 3)} AS mean_wait_s,
             {rounded('max(wait_s)', 2)} AS longest_wait_s, count(*) FILTER (WHERE status IN (403, 407, 429)) AS bans,
             {rounded('count(*) FILTER (WHERE status BETWEEN 200 AND 399) / count(*)::DOUBLE', 4)} AS success_rate FROM requests_v GROUP BY platform""",
)
def request_stats(t):
    return rl.request_stats(t.requests_v)
