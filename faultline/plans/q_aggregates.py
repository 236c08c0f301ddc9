"""Registered aggregation, trend, window and top-k queries (A*, W*, T*)."""

from __future__ import annotations

from faultline.operators import aggregates as AG
from faultline.operators import reports as RP
from faultline.operators import topk as TK
from faultline.operators import trends as TR
from faultline.plans.oracle import HOURLY_SQL, with_
from faultline.plans.registry import query
from faultline.sources import tables as T

AS_OF = T.AS_OF
A = "TIMESTAMP '2024-01-31 00:00:00'"
HOURLY = HOURLY_SQL
W7 = f"created_at >= {A} - INTERVAL 7 DAY"


def _err(spark, sf):
    return T.errors(spark, sf)


KPI_SQL = f"""SELECT count(*) AS total_errors, count(DISTINCT error_id) AS unique_errors,
  count(*) FILTER (WHERE NOT is_resolved) AS unresolved_errors, count(*) FILTER (WHERE is_resolved) AS resolved_errors,
  CAST(CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE is_resolved) / count(*), 1) ELSE 0 END AS DOUBLE) AS resolution_rate,
  round(count(*) / 7.0, 2) AS avg_errors_per_day, count(DISTINCT user_id) AS affected_users,
  round(avg(response_ms), 2) AS avg_response_time
FROM err WHERE {W7}"""


@query("analytics_kpis", with_("err", body=KPI_SQL))
def analytics_kpis(spark, sf):
    return AG.analytics_kpis(_err(spark, sf), AS_OF, 7)


@query("affected_users", with_("err", body=f"SELECT count(DISTINCT user_id) AS affected_users FROM err WHERE {W7}"))
def affected_users(spark, sf):
    return AG.affected_users(_err(spark, sf), AS_OF, 7)


@query("avg_response_time", with_("err", body=f"SELECT round(avg(response_ms), 2) AS avg_response_time FROM err WHERE {W7}"))
def avg_response_time(spark, sf):
    return AG.avg_response_time(_err(spark, sf), AS_OF, 7)


TOP_GROUPS_SQL = f"""SELECT error_code, message, count(*) AS count FROM err WHERE {W7} GROUP BY ALL
ORDER BY count DESC, error_code ASC NULLS FIRST, message LIMIT 10"""


@query("top_error_groups", with_("err", body=TOP_GROUPS_SQL))
def top_error_groups(spark, sf):
    return AG.top_error_groups(_err(spark, sf), AS_OF, 7, 10)


@query("errors_by_status", with_("err", body=f"SELECT status_code, count(*) AS count FROM err WHERE {W7} GROUP BY 1"))
def errors_by_status(spark, sf):
    return AG.errors_by_status(_err(spark, sf), AS_OF, 7)


@query(
    "status_distribution",
    with_(
        "err",
        body=f"""SELECT status_code, count(*) AS count,
  CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS DOUBLE) AS percentage
FROM err WHERE {W7} GROUP BY 1""",
    ),
)
def status_distribution(spark, sf):
    return AG.status_distribution(_err(spark, sf), AS_OF, 7)


@query(
    "error_stats",
    with_(
        "err",
        body=f"""SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_resolved) AS unresolved,
  count(*) FILTER (WHERE is_resolved) AS resolved,
  count(*) FILTER (WHERE CAST(created_at AS DATE) = CAST({A} AS DATE)) AS today,
  count(*) FILTER (WHERE created_at >= date_trunc('week', {A})) AS this_week,
  count(*) FILTER (WHERE created_at >= date_trunc('month', {A})) AS this_month
FROM err""",
    ),
)
def error_stats(spark, sf):
    return AG.error_stats(_err(spark, sf), AS_OF)


LABELS = {
    "hour": "strftime(created_at, '%Y-%m-%d %H:00:00')",
    "day": "strftime(created_at, '%Y-%m-%d')",
    "week": "strftime(created_at, '%G-%V')",
    "month": "strftime(created_at, '%Y-%m')",
    "minute": "strftime(created_at, '%Y-%m-%d %H:%M:00')",
}


def _trend_sql(interval: str, days: int) -> str:
    return with_(
        "err",
        body=f"SELECT {LABELS[interval]} AS period, count(*) AS count FROM err "
        f"WHERE created_at >= {A} - INTERVAL {days} DAY GROUP BY 1",
    )


def _trend_query(interval: str, days: int):
    def fn(spark, sf):
        return TR.trend(_err(spark, sf), AS_OF, days, interval)

    return fn


TREND_DAYS = {"hour": 7, "day": 30, "week": 30, "month": 30, "minute": 1}
for _iv, _d in TREND_DAYS.items():
    query(f"trend_{_iv}", _trend_sql(_iv, _d))(_trend_query(_iv, _d))


@query("error_rate_series", _trend_sql("hour", 1))
def error_rate_series(spark, sf):
    return TR.error_rate_series(_err(spark, sf), AS_OF, 1)


TREND_DAY_CTE = f""", b AS (SELECT strftime(created_at, '%Y-%m-%d') AS period, count(*) AS count FROM err
  WHERE created_at >= {A} - INTERVAL 30 DAY GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS rank_desc, max(count) OVER () AS max_count FROM b)
"""


def _buckets(spark, sf):
    return TR.trend(_err(spark, sf), AS_OF, 30, "day")


@query(
    "trend_direction",
    with_(
        "err",
        body=TREND_DAY_CTE
        + """, a AS (SELECT count(*) AS buckets, avg(count) FILTER (WHERE rank_desc <= 3) AS recent_avg,
  avg(count) FILTER (WHERE rank_desc BETWEEN 4 AND 6) AS previous_avg FROM r)
SELECT round(recent_avg, 4) AS recent_avg, round(previous_avg, 4) AS previous_avg,
  round((recent_avg - previous_avg) / previous_avg * 100.0, 1) AS change_pct,
  CASE WHEN (recent_avg - previous_avg) / previous_avg * 100.0 > 0 THEN 'up' ELSE 'down' END AS direction
FROM a WHERE buckets >= 2 AND previous_avg > 0""",
    ),
)
def trend_direction(spark, sf):
    return TR.trend_direction(_buckets(spark, sf))


@query("trend_last7", with_("err", body=TREND_DAY_CTE + "SELECT period, count FROM r WHERE rank_desc <= 7"))
def trend_last7(spark, sf):
    return TR.trend_last(_buckets(spark, sf), 7)


@query("trend_first5", with_("err", body=TREND_DAY_CTE + "SELECT period, count FROM b ORDER BY period LIMIT 5"))
def trend_first5(spark, sf):
    return TR.trend_first(_buckets(spark, sf), 5)


@query(
    "trend_bars",
    with_(
        "err",
        body=TREND_DAY_CTE
        + """SELECT period, count, CAST(round(count / max_count * 20) AS INT) AS filled,
  repeat('█', CAST(round(count / max_count * 20) AS INT)) || repeat('░', 20 - CAST(round(count / max_count * 20) AS INT)) AS bar
FROM r WHERE rank_desc <= 7""",
    ),
)
def trend_bars(spark, sf):
    return TR.trend_bars(_buckets(spark, sf), 20)


@query(
    "trend_rows",
    with_(
        "err",
        body=f""", trend AS (SELECT CAST(created_at AS DATE) AS date, error_code, status_code, CAST(count(*) AS BIGINT) AS count,
    {HOURLY} AS hourly_distribution
  FROM err GROUP BY ALL)
SELECT * FROM trend WHERE date >= CAST({A} - INTERVAL 7 DAY AS DATE)""",
    ),
)
def trend_rows(spark, sf):
    return TR.trend_rows(TR.daily_trends(_err(spark, sf), "occurrences"), AS_OF, 7)


@query(
    "daily_trends",
    with_(
        "err",
        body=""", firsts AS (SELECT arg_min_null(created_at, (created_at, id)) AS created_at,
    arg_min_null(error_code, (created_at, id)) AS error_code, arg_min_null(status_code, (created_at, id)) AS status_code
  FROM err GROUP BY error_id)
SELECT CAST(created_at AS DATE) AS date, error_code, status_code, count(*) AS count,
  {HOURLY} AS hourly_distribution
FROM firsts GROUP BY ALL""",
    ),
)
def daily_trends(spark, sf):
    return TR.daily_trends(_err(spark, sf), "first")


TOP_ROWS_SQL = f"""SELECT id, message, error_code AS code, status_code, occurrence_count AS count, request_url AS endpoint
FROM err WHERE {W7} ORDER BY occurrence_count DESC, id DESC LIMIT 10"""


@query("top_errors", with_("err", body=TOP_ROWS_SQL))
def top_errors(spark, sf):
    return TK.top_errors(_err(spark, sf), AS_OF, 10, 7)


@query(
    "top_errors_ranked",
    with_(
        "err",
        body=f""", t AS ({TOP_ROWS_SQL})
SELECT '#' || CAST(row_number() OVER (ORDER BY count DESC, id DESC) AS VARCHAR) AS rank,
  CASE WHEN length(message) > 50 THEN substring(message, 1, 50) || '...' ELSE message END AS message,
  coalesce(endpoint, 'N/A') AS endpoint, count FROM t""",
    ),
)
def top_errors_ranked(spark, sf):
    return TK.top_errors_ranked(TK.top_errors(_err(spark, sf), AS_OF, 10, 7))


@query(
    "list_sorted",
    with_("err", body="SELECT * FROM err WHERE NOT is_resolved ORDER BY occurrence_count ASC, id ASC LIMIT 25"),
)
def list_sorted(spark, sf):
    return TK.list_sorted(_err(spark, sf), "occurrence_count", "asc", 25, {"status": "unresolved"})


@query(
    "dashboard_widgets",
    with_(
        "err",
        body=f""", t AS (SELECT 'top_errors' AS widget, id, message, status_code FROM err WHERE {W7}
    ORDER BY occurrence_count DESC, id DESC LIMIT 5),
r AS (SELECT 'recent' AS widget, id, message, status_code FROM err ORDER BY created_at DESC, id DESC LIMIT 10)
SELECT * FROM t UNION ALL SELECT * FROM r""",
    ),
)
def dashboard_widgets(spark, sf):
    return TK.dashboard_widgets(_err(spark, sf), AS_OF, 7)


@query(
    "list_summary",
    with_(
        "err",
        body=""", f AS (SELECT * FROM err WHERE status_code = 503),
s AS (SELECT status_code, count(*) AS n FROM f GROUP BY 1)
SELECT (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f WHERE resolved_at IS NOT NULL) AS resolved,
  (SELECT count(*) FROM f WHERE resolved_at IS NULL) AS unresolved,
  (SELECT status_code FROM s ORDER BY n DESC, status_code ASC LIMIT 1) AS top_status_code""",
    ),
)
def list_summary(spark, sf):
    return AG.list_summary(_err(spark, sf), {"status_code": 503})


BSTATS_SQL = f"""SELECT count(*) AS total, count(*) FILTER (WHERE state = 'open') AS open,
  count(*) FILTER (WHERE state = 'half_open') AS half_open, count(*) FILTER (WHERE state = 'closed') AS closed,
  count(*) FILTER (WHERE last_failure_at >= {A} - INTERVAL 1 HOUR) AS recent_failures FROM cb"""


@query("breaker_stats", with_("cb", body=BSTATS_SQL))
def breaker_stats(spark, sf):
    return AG.breaker_stats(T.breakers(spark, sf), AS_OF)


@query("breaker_list_summary", with_("cb", body=BSTATS_SQL + " WHERE contains(service, 'service')"))
def breaker_list_summary(spark, sf):
    from pyspark.sql import functions as F

    return AG.breaker_stats(T.breakers(spark, sf).filter(F.col("service").contains("service")), AS_OF)


@query(
    "breaker_health",
    with_(
        "cb",
        body="""SELECT count(*) FILTER (WHERE state = 'open') = 0 AS is_healthy,
  CASE WHEN count(*) FILTER (WHERE state = 'open') = 0 THEN 'All circuit breakers closed'
    ELSE CAST(count(*) FILTER (WHERE state = 'open') AS VARCHAR) || ' circuit breaker(s) open' END AS message,
  count(*) AS total, count(*) FILTER (WHERE state = 'closed') AS healthy,
  count(*) FILTER (WHERE state = 'open') AS open, count(*) FILTER (WHERE state = 'half_open') AS half_open FROM cb""",
    ),
)
def breaker_health(spark, sf):
    return AG.breaker_health(T.breakers(spark, sf))


@query(
    "breaker_health_strict",
    with_(
        "cb",
        body="""SELECT CASE WHEN count(*) FILTER (WHERE state = 'closed') = count(*) THEN 'healthy' ELSE 'degraded' END AS status,
  count(*) FILTER (WHERE state = 'closed') AS healthy_breakers, count(*) AS total_breakers FROM cb""",
    ),
)
def breaker_health_strict(spark, sf):
    return AG.breaker_health_strict(T.breakers(spark, sf))


@query(
    "system_health",
    with_(
        "err",
        "cb",
        body=""", checks AS (SELECT 'errors_table' AS "check", count(*) >= 0 AS healthy FROM err
  UNION ALL SELECT 'circuit_breakers', count(*) FILTER (WHERE state = 'open') = 0 FROM cb)
SELECT CASE WHEN bool_and(healthy) THEN 'healthy' ELSE 'degraded' END AS status, count(*) AS checks,
  count(*) FILTER (WHERE NOT healthy) AS failing FROM checks""",
    ),
)
def system_health(spark, sf):
    return AG.system_health(AG.health_checks(_err(spark, sf), T.breakers(spark, sf)))


@query(
    "health_class",
    with_(
        "err",
        "cb",
        body=f""", u AS (SELECT count(*) FILTER (WHERE NOT is_resolved) AS unresolved FROM err WHERE {W7}),
o AS (SELECT count(*) FILTER (WHERE state = 'open') AS open_breakers FROM cb)
SELECT unresolved, open_breakers, CASE WHEN unresolved = 0 AND open_breakers = 0 THEN 'EXCELLENT'
  WHEN unresolved <= 5 AND open_breakers = 0 THEN 'GOOD' WHEN unresolved <= 10 OR open_breakers <= 2 THEN 'WARNING'
  ELSE 'CRITICAL' END AS health FROM u, o""",
    ),
)
def health_class(spark, sf):
    return AG.health_class(_err(spark, sf), T.breakers(spark, sf), AS_OF, 7)


@query(
    "recommendations",
    with_(
        "err",
        body=f""", w AS (SELECT * FROM err WHERE {W7}),
k AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_resolved) AS unresolved,
  count(*) FILTER (WHERE is_resolved) AS resolved FROM w),
t AS (SELECT count(*) AS top_count FROM w GROUP BY error_code, message ORDER BY count(*) DESC, error_code ASC NULLS FIRST, message LIMIT 1),
r AS (SELECT CASE WHEN unresolved > 10 THEN 'unresolved_attention' END AS a,
  CASE WHEN coalesce((SELECT top_count FROM t), 0) > 5 THEN 'investigate_top_error' END AS b,
  CASE WHEN (CASE WHEN total > 0 THEN resolved * 100.0 / total ELSE 0 END) < 50 THEN 'low_resolution_rate' END AS c,
  CASE WHEN unresolved = 0 AND total > 0 THEN 'all_resolved' END AS d FROM k)
SELECT recommendation FROM (SELECT unnest([a, b, c, d]) AS recommendation FROM r) WHERE recommendation IS NOT NULL""",
    ),
)
def recommendations(spark, sf):
    return AG.recommendations(_err(spark, sf), AS_OF, 7)


@query(
    "retention_count",
    with_("err", body=f"SELECT count(*) AS count FROM err WHERE created_at < {A} - INTERVAL 20 DAY"),
)
def retention_count(spark, sf):
    return AG.retention_count(_err(spark, sf), AS_OF, 20, "all")


@query(
    "peak_hour",
    with_("err", body=f"SELECT CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS count FROM err WHERE {W7} GROUP BY 1 ORDER BY count DESC, hour LIMIT 1"),
)
def peak_hour(spark, sf):
    return AG.peak_hour(_err(spark, sf), AS_OF, 7)


@query(
    "error_rate_pct",
    with_(
        "calls",
        body="""SELECT count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failed,
  CAST(CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE NOT ok) / count(*), 2) ELSE 0 END AS DOUBLE) AS error_rate FROM calls""",
    ),
)
def error_rate_pct(spark, sf):
    return AG.error_rate_pct(T.calls(spark, sf))


ANALYSIS_REPORT_SQL = with_(
    "err",
    body=f""", k AS ({KPI_SQL}),
t AS ({TOP_ROWS_SQL}),
d AS (SELECT status_code, count(*) AS count,
  CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS DOUBLE) AS percentage FROM err WHERE {W7} GROUP BY 1),
p AS (SELECT strftime(created_at, '%Y-%m-%d') AS period, count(*) AS count FROM err WHERE {W7} GROUP BY 1)
SELECT json_object('period', '7 days',
  'analytics', (SELECT json_object('total_errors', total_errors, 'unique_errors', unique_errors, 'unresolved_errors', unresolved_errors,
    'resolved_errors', resolved_errors, 'resolution_rate', resolution_rate, 'avg_errors_per_day', avg_errors_per_day,
    'affected_users', affected_users, 'avg_response_time', avg_response_time) FROM k),
  'top_errors', (SELECT list(CASE WHEN code IS NULL
      THEN json_object('id', id, 'message', message, 'status_code', status_code, 'count', count, 'endpoint', endpoint)
      ELSE json_object('id', id, 'message', message, 'code', code, 'status_code', status_code, 'count', count, 'endpoint', endpoint) END
    ORDER BY count DESC, id DESC) FROM t),
  'distribution', (SELECT list(json_object('status_code', status_code, 'count', count, 'percentage', percentage) ORDER BY status_code) FROM d),
  'trends', (SELECT list(json_object('period', period, 'count', count) ORDER BY period) FROM p))::VARCHAR AS report""",
)


@query("analysis_report", ANALYSIS_REPORT_SQL)
def analysis_report(spark, sf):
    return RP.analysis_report(_err(spark, sf), AS_OF, 7)


STATS_REPORT_SQL = with_(
    "err",
    "cb",
    body=f""", k AS ({KPI_SQL}), b AS ({BSTATS_SQL})
SELECT json_object('period_days', 7,
  'errors', json_object('total_errors', total_errors, 'unique_errors', unique_errors, 'unresolved_errors', unresolved_errors,
    'resolved_errors', resolved_errors, 'resolution_rate', resolution_rate, 'avg_errors_per_day', avg_errors_per_day,
    'affected_users', affected_users, 'avg_response_time', avg_response_time),
  'circuit_breakers', json_object('total', total, 'open', open, 'half_open', half_open, 'closed', closed,
    'recent_failures', recent_failures))::VARCHAR AS report FROM k, b""",
)


@query("stats_report", STATS_REPORT_SQL)
def stats_report(spark, sf):
    return RP.stats_report(_err(spark, sf), T.breakers(spark, sf), AS_OF, 7)
