"""Registered streaming jobs (X1, X2, X6, X7), run with ``availableNow`` and
read back from their shared-folder sinks.  Each has a DuckDB twin;
``tests/test_streaming.py`` checks stream == batch."""

from __future__ import annotations

from faultline.plans.oracle import HOURLY_SQL, with_
from faultline.plans.q_breaker import CFG, FOLD_SQL
from faultline.plans.registry import query

ATTRS = "exception_class, error_code, message, status_code, request_method, request_url, user_id"
LIVE_SQL = with_(
    "err",
    body="""SELECT id, error_id, message, error_code, status_code, occurrence_count, request_url, request_method,
  ip_address, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, is_resolved FROM err""",
)
TRENDS_SQL = with_(
    "err",
    body="""SELECT CAST(created_at AS DATE) AS date, error_code, status_code, CAST(count(*) AS BIGINT) AS count,
  {HOURLY} AS hourly_distribution FROM err GROUP BY ALL""",
)
COLLECT_SQL = with_("rollup", body=f"SELECT error_id, id, {ATTRS}, occurrence_count, first_occurred_at, last_occurred_at FROM rollup")
FIRST_SQL = with_(
    "rollup",
    body=", r AS (SELECT first_occurred_at AS created_at, error_code, status_code FROM rollup) "
    "SELECT CAST(created_at AS DATE) AS date, error_code, status_code, count(*) AS count, {HOURLY} AS hourly_distribution "
    "FROM r GROUP BY ALL",
)
from faultline.streaming import jobs as S


@query("stream_live_feed", LIVE_SQL)
def stream_live_feed(spark, sf):
    _, table = S.live_feed(spark, sf, available_now=True)
    return spark.read.parquet(table)


@query("stream_daily_trends", TRENDS_SQL)
def stream_daily_trends(spark, sf):
    return S.daily_trend_stream(spark, sf, available_now=True)[1].read()


@query("stream_collect", COLLECT_SQL)
def stream_collect(spark, sf):
    return S.collected(S.collect_stream(spark, sf, available_now=True)[1])


@query("stream_breaker", FOLD_SQL)
def stream_breaker(spark, sf):
    return S.breaker_states(S.breaker_stream(spark, sf, CFG, available_now=True)[1])


@query("stream_first_sighting_trends", FIRST_SQL)
def stream_first_sighting_trends(spark, sf):
    """First-sighting trends kept current from the continuously collected roll-up."""
    return S.first_sighting_trends(S.collected(S.collect_stream(spark, sf, available_now=True)[1]))
