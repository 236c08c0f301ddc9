"""Registered source / export queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from faultline import config as C
from faultline.operators import aggregates as AG
from faultline.operators import reports as RP
from faultline.operators import shapes as SH
from faultline.operators import topk as TK
from faultline.operators import trends as TR
from faultline.plans.oracle import with_
from faultline.plans.q_redact import JSON_SQL
from faultline.plans.registry import query
from faultline.session import ensure_checkpoint_dir
from faultline.sources import stored as ST
from faultline.sources import tables as T

AS_OF = T.AS_OF
A = "TIMESTAMP '2024-01-31 00:00:00'"
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def iso(c: str) -> str:
    return ISO.format(c=c)


def _err(spark, sf):
    return T.errors(spark, sf)


@query("scan_errors", with_("err", body="SELECT * FROM err"))
def scan_errors(spark, sf):
    return _err(spark, sf)


TREND_SQL = """trend AS (
  SELECT CAST(created_at AS DATE) AS date, error_code, status_code, CAST(count(*) AS BIGINT) AS count,
    {HOURLY} AS hourly_distribution
  FROM err GROUP BY ALL
)"""


def trend_table(spark, sf):
    """The trends table: A11 over the errors, counting every occurrence."""
    return TR.daily_trends(_err(spark, sf), count_mode="occurrences")


@query("scan_trends", with_("err", body=", " + TREND_SQL + " SELECT * FROM trend"))
def scan_trends(spark, sf):
    return trend_table(spark, sf)


@query("scan_breakers", with_("cb", body="SELECT * FROM cb"))
def scan_breakers(spark, sf):
    return T.breakers(spark, sf)


@query(
    "live_errors",
    with_(
        "err",
        body="""SELECT id, error_id, message, error_code, status_code, occurrence_count, request_url, request_method,
  ip_address, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, is_resolved
FROM err ORDER BY created_at DESC, id DESC LIMIT 50""",
    ),
)
def live_errors(spark, sf):
    return TK.live_errors(_err(spark, sf), C.LIVE_FEED_LIMIT)


EXPORT_SQL = f"""SELECT id, error_code, message, status_code, request_url, request_method, occurrence_count,
  {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at, resolved_at IS NOT NULL AS is_resolved
FROM err WHERE created_at >= {A} - INTERVAL 7 DAY"""


@query("export_errors", with_("err", body=EXPORT_SQL))
def export_errors(spark, sf):
    return SH.export_errors(_err(spark, sf), AS_OF, 7)


@query(
    "export_errors_csv_rows",
    with_(
        "err",
        body=f"""SELECT id AS "ID", coalesce(error_code, '') AS "Error Code", coalesce(message, '') AS "Message",
  status_code AS "Status Code", coalesce(request_url, '') AS "Endpoint", coalesce(request_method, '') AS "Method",
  coalesce(occurrence_count, 0) AS "Occurrences", coalesce({iso('created_at')}, '') AS "First Seen",
  coalesce({iso('updated_at')}, '') AS "Last Seen", CASE WHEN resolved_at IS NOT NULL THEN 'Yes' ELSE 'No' END AS "Resolved"
FROM err WHERE created_at >= {A} - INTERVAL 7 DAY""",
    ),
)
def export_errors_csv_rows(spark, sf):
    return SH.export_errors_csv_rows(SH.export_errors(_err(spark, sf), AS_OF, 7))


@query(
    "export_trends_rows",
    with_(
        "err",
        body=f"""SELECT strftime(created_at, '%Y-%m-%d') AS "Period", count(*) AS "Error Count"
FROM err WHERE created_at >= {A} - INTERVAL 7 DAY GROUP BY 1""",
    ),
)
def export_trends_rows(spark, sf):
    return SH.export_trends_rows(TR.trend(_err(spark, sf), AS_OF, 7, "day"))


@query(
    "export_analytics_rows",
    with_(
        "err",
        body=f""", w AS (SELECT * FROM err WHERE created_at >= {A} - INTERVAL 7 DAY),
k AS (SELECT count(*) AS t, count(DISTINCT error_id) AS u, count(*) FILTER (WHERE is_resolved) AS r,
  count(*) FILTER (WHERE NOT is_resolved) AS ur FROM w),
g AS (SELECT error_code, message, count(*) AS n FROM w GROUP BY ALL
  ORDER BY n DESC, error_code ASC NULLS FIRST, message LIMIT 10)
SELECT 'metrics' AS section, 1 AS ordinal, 'Total Errors' AS "Metric", CAST(t AS VARCHAR) AS "Value" FROM k
UNION ALL SELECT 'metrics', 2, 'Unique Errors', CAST(u AS VARCHAR) FROM k
UNION ALL SELECT 'metrics', 3, 'Resolved Errors', CAST(r AS VARCHAR) FROM k
UNION ALL SELECT 'metrics', 4, 'Unresolved Errors', CAST(ur AS VARCHAR) FROM k
UNION ALL SELECT 'metrics', 5, 'Average per Day', CAST(round(t / 7.0, 2) AS VARCHAR) FROM k
UNION ALL SELECT 'top_errors', CAST(row_number() OVER (ORDER BY n DESC, error_code ASC NULLS FIRST, message) AS INTEGER),
  coalesce(message, 'Unknown'), CAST(n AS VARCHAR) FROM g""",
    ),
)
def export_analytics_rows(spark, sf):
    e = _err(spark, sf)
    return SH.export_analytics_rows(AG.analytics_kpis(e, AS_OF, 7), AG.top_error_groups(e, AS_OF, 7, 10))


EXPORT_JSON_SQL = with_(
    "err",
    body=f""", x AS ({EXPORT_SQL})
SELECT CASE WHEN error_code IS NULL
  THEN json_object('id', id, 'message', message, 'status_code', status_code, 'request_url', request_url,
    'request_method', request_method, 'occurrence_count', occurrence_count, 'created_at', created_at,
    'updated_at', updated_at, 'is_resolved', is_resolved)
  ELSE json_object('id', id, 'error_code', error_code, 'message', message, 'status_code', status_code, 'request_url', request_url,
    'request_method', request_method, 'occurrence_count', occurrence_count, 'created_at', created_at,
    'updated_at', updated_at, 'is_resolved', is_resolved) END::VARCHAR AS json FROM x""",
)


@query("export_json_lines", EXPORT_JSON_SQL)
def export_json_lines(spark, sf):
    return SH.json_lines(SH.export_errors(_err(spark, sf), AS_OF, 7))


@query(
    "cli_export_csv_rows",
    with_(
        "err",
        body=f"""SELECT error_id AS "Error ID", message AS "Message", status_code AS "Status Code", request_method AS "Method",
  request_url AS "URL", occurrence_count AS "Occurrence Count", CASE WHEN resolved_at IS NOT NULL THEN 'Yes' ELSE 'No' END AS "Resolved",
  {iso('created_at')} AS "Created At", {iso('updated_at')} AS "Updated At"
FROM err WHERE NOT is_resolved AND created_at >= CAST(CAST({A} - INTERVAL 10 DAY AS DATE) AS TIMESTAMP)""",
    ),
)
def cli_export_csv_rows(spark, sf):
    return SH.cli_export_csv_rows(SH.cli_export_rows(_err(spark, sf), AS_OF, days=10, status="unresolved"))


@query(
    "cli_export_json",
    with_(
        "err",
        body=f"""SELECT json_object('error_id', error_id, 'message', message, 'exception_class', exception_class,
  'status_code', status_code, 'request_method', request_method, 'request_url', request_url,
  'occurrence_count', occurrence_count, 'resolved', resolved_at IS NOT NULL, 'resolved_at', {iso('resolved_at')},
  'created_at', {iso('created_at')}, 'updated_at', {iso('updated_at')})::VARCHAR AS json FROM err""",
    ),
)
def cli_export_json(spark, sf):
    return SH.cli_export_json(SH.cli_export_rows(_err(spark, sf), AS_OF, days=0))


@query(
    "error_catalogue_coverage",
    with_(
        "err",
        body=", cat(code, status, title, description, example) AS (VALUES "
        + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in C.ERROR_CATALOGUE)
        + """),
s AS (SELECT status_code, count(*) AS n FROM err GROUP BY 1)
SELECT code, status, title, description, example, coalesce(n, 0) AS errors FROM cat LEFT JOIN s ON s.status_code = cat.status""",
    ),
)
def error_catalogue_coverage(spark, sf):
    return RP.error_catalogue_coverage(spark, _err(spark, sf))


@query(
    "doc_stats",
    with_(
        "err",
        body=f""", w AS (SELECT * FROM err WHERE created_at >= {A} - INTERVAL 30 DAY),
k AS (SELECT count(*) AS t, count(DISTINCT error_id) AS u, count(*) FILTER (WHERE NOT is_resolved) AS ur,
  count(*) FILTER (WHERE is_resolved) AS r FROM w),
top AS (SELECT message, occurrence_count, row_number() OVER (ORDER BY occurrence_count DESC, id DESC) AS rk FROM w
  ORDER BY occurrence_count DESC, id DESC LIMIT 10)
SELECT 'stats' AS section, 1 AS ordinal, 'Total Errors' AS label, t AS value FROM k
UNION ALL SELECT 'stats', 2, 'Unique Errors', u FROM k
UNION ALL SELECT 'stats', 3, 'Unresolved', ur FROM k
UNION ALL SELECT 'stats', 4, 'Resolved', r FROM k
UNION ALL SELECT 'top_errors', CAST(rk AS INTEGER), message, occurrence_count FROM top WHERE rk <= 5""",
    ),
)
def doc_stats(spark, sf):
    return RP.doc_stats(_err(spark, sf), AS_OF, 30)


# ---- stored tables -----------------------------------------------------------------


def _stored(spark, make):
    """A fresh stored table under the shared checkpoint folder."""
    return make(spark, os.path.join(ensure_checkpoint_dir(spark), "stored", uuid.uuid4().hex))


_RAW_META = JSON_SQL["stored_meta"]
STORED_SQL = with_(
    "err",
    body=f""", meta AS ({_RAW_META})
SELECT err.id, error_id, request_method, request_url, '{{"Accept":"application/json","Authorization":"[REDACTED]","X-Request-Id":"req-' || err.id || '"}}' AS request_headers,
  CASE WHEN err.id % 2 = 0 THEN '{{"amount":' || k || ',"password":"[REDACTED]"}}' END AS request_data, user_id, ip_address, user_agent,
  CASE WHEN err.id % 8 < 7 THEN payload END AS meta, CASE WHEN is_resolved THEN 'ops' END AS resolved_by, created_at AS first_occurred_at
FROM err JOIN meta ON meta.id = err.id JOIN (SELECT event_id AS id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) ks ON ks.id = err.id
WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-21'""",
)


@query("scan_stored_errors", STORED_SQL)
def scan_stored_errors(spark, sf):
    """Eleven days read back from a stored errors table."""
    table = _stored(spark, ST.errors_table)
    table.write(T.stored_errors(spark, sf))
    return table.read(since="2024-01-10", until="2024-01-20").select(
        "id", "error_id", "request_method", "request_url", "request_headers", "request_data", "user_id", "ip_address", "user_agent", "meta",
        "resolved_by", "first_occurred_at",
    )


@query("scan_stored_trends", with_("err", body=", " + TREND_SQL + " SELECT * FROM trend WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"))
def scan_stored_trends(spark, sf):
    table = _stored(spark, ST.trends_table)
    table.write(trend_table(spark, sf))
    return table.read(since="2024-01-10", until="2024-01-20")


@query("scan_stored_breakers", with_("cb", body="SELECT * REPLACE (CAST(failure_threshold AS INTEGER) AS failure_threshold, CAST(success_threshold AS INTEGER) AS success_threshold) FROM cb"))
def scan_stored_breakers(spark, sf):
    table = _stored(spark, ST.breakers_table)
    table.write(T.breakers(spark, sf))
    return table.read()


@query("request_meta", with_("err", body="SELECT id, request_method AS method, request_url AS url, ip_address AS ip, user_agent FROM err"))
def request_meta(spark, sf):
    return _err(spark, sf).select("id", ST.request_meta(_err(spark, sf)).alias("m")).select("id", "m.*")


MERGE_SQL = with_(
    "rollup",
    body="SELECT error_id, occurrence_count, first_occurred_at, last_occurred_at FROM rollup",
)


@query("merge_stored_errors", MERGE_SQL)
def merge_stored_errors(spark, sf):
    """Two batches of sightings merged into a stored table, which rewrites the days that they touch."""
    table = _stored(spark, ST.errors_table)
    seen = T.stored_errors(spark, sf).withColumn("occurrence_count", F.lit(1))
    for part in (0, 1):
        ST.merge_errors(table, seen.where(F.col("id") % 2 == part))
    return table.read().select("error_id", "occurrence_count", "first_occurred_at", "last_occurred_at")
