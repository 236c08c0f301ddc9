"""Registered joins, roll-ups and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import classify as CL
from faultline.operators import joins as J
from faultline.operators import maintenance as D
from faultline.operators import trends as TR
from faultline.plans.oracle import with_
from faultline.plans.registry import query
from faultline.sources import tables as T

AS_OF = T.AS_OF
A = "TIMESTAMP '2024-01-31 00:00:00'"
CUT = "2024-01-02 00:00:00"
CUT_SQL = f"TIMESTAMP '{CUT}'"
ATTRS = "exception_class, error_code, message, status_code, request_method, request_url, user_id"


def _err(spark, sf):
    return T.errors(spark, sf)


def _split(spark, sf):
    e = _err(spark, sf)
    before = e.filter(F.col("created_at") < T.ts(CUT))
    after = e.filter(F.col("created_at") >= T.ts(CUT))
    return before, after


TREND_OCC = """trend AS (SELECT CAST(created_at AS DATE) AS date, error_code, status_code, CAST(count(*) AS BIGINT) AS count,
  {HOURLY} AS hourly_distribution FROM err GROUP BY ALL)"""


@query(
    "error_occurrences",
    with_("rollup", body=f"SELECT error_id, id, {ATTRS}, occurrence_count, first_occurred_at, last_occurred_at FROM rollup"),
)
def error_occurrences(spark, sf):
    return J.error_occurrences(_err(spark, sf))


@query(
    "errors_with_trends",
    with_(
        "err",
        body=f""", {TREND_OCC},
pc AS (SELECT error_code, count(*) AS trend_rows, sum(count) AS trend_total FROM trend WHERE error_code IS NOT NULL GROUP BY 1)
SELECT id, err.error_code, coalesce(trend_rows, 0) AS trend_rows, CAST(coalesce(trend_total, 0) AS BIGINT) AS trend_total
FROM err LEFT JOIN pc ON err.error_code = pc.error_code""",
    ),
)
def errors_with_trends(spark, sf):
    e = _err(spark, sf)
    return J.errors_with_trends(e, TR.daily_trends(e, "occurrences"))


@query(
    "errors_with_trend_rows",
    with_(
        "rollup",
        body=f""", {TREND_OCC}
SELECT id, error_id, rollup.error_code, CAST(date_trunc('month', date) AS DATE) AS month, date, trend.status_code, count
FROM rollup LEFT JOIN trend ON rollup.error_code = trend.error_code""",
    ),
)
def errors_with_trend_rows(spark, sf):
    """The rolled-up errors with the nested trend rows of their codes, unnested again to compare."""
    e = _err(spark, sf)
    nested = J.errors_with_trend_rows(J.error_occurrences(e), TR.daily_trends(e, "occurrences"))
    return nested.select("id", "error_id", "error_code", "month", F.explode_outer("trends").alias("t")).select("id", "error_id", "error_code", "month", "t.*")


@query(
    "related_errors",
    with_(
        "err",
        body=""", cand AS (SELECT request_url, id AS related_id, created_at AS related_at,
    row_number() OVER (PARTITION BY request_url ORDER BY created_at DESC, id DESC) AS rn FROM err QUALIFY rn <= 6),
pairs AS (SELECT e.id, c.related_id, c.related_at FROM err e JOIN cand c ON e.request_url = c.request_url WHERE e.id <> c.related_id)
SELECT id, related_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY related_at DESC, related_id DESC) AS rank FROM pairs)
WHERE rank <= 5""",
    ),
)
def related_errors(spark, sf):
    return J.related_errors(_err(spark, sf), 5)


ROLL_BEFORE = f"""rb AS (SELECT error_id FROM err WHERE created_at < {CUT_SQL} GROUP BY 1)"""


@query("known_errors", with_("err", body=f", {ROLL_BEFORE} SELECT * FROM err WHERE created_at >= {CUT_SQL} AND error_id IN (SELECT error_id FROM rb)"))
def known_errors(spark, sf):
    before, after = _split(spark, sf)
    return J.known_errors(after, J.error_occurrences(before))


@query("new_errors", with_("err", body=f", {ROLL_BEFORE} SELECT * FROM err WHERE created_at >= {CUT_SQL} AND error_id NOT IN (SELECT error_id FROM rb)"))
def new_errors(spark, sf):
    before, after = _split(spark, sf)
    return J.new_errors(after, J.error_occurrences(before))


@query(
    "breaker_get_or_create",
    with_(
        "calls",
        "cb",
        body=""", keys AS (SELECT DISTINCT service, operation FROM calls),
ex AS (SELECT service, operation, arg_min_null(id, id) AS id, arg_min_null(state, id) AS state, arg_min_null(failure_threshold, id) AS ft,
  arg_min_null(recovery_timeout, id) AS rt, arg_min_null(success_threshold, id) AS st FROM cb GROUP BY ALL)
SELECT k.service, k.operation, ex.id IS NULL AS created, ex.id AS breaker_id, coalesce(ex.state, 'closed') AS state,
  coalesce(ex.ft, 5) AS failure_threshold, coalesce(ex.rt, 60) AS recovery_timeout, coalesce(ex.st, 3) AS success_threshold
FROM keys k LEFT JOIN ex ON k.service IS NOT DISTINCT FROM ex.service AND k.operation IS NOT DISTINCT FROM ex.operation""",
    ),
)
def breaker_get_or_create(spark, sf):
    return J.breaker_get_or_create(T.calls(spark, sf), T.breakers(spark, sf))


def _trend_sql_where(cond: str) -> str:
    return f"""(SELECT CAST(created_at AS DATE) AS date, error_code, status_code, CAST(count(*) AS BIGINT) AS count,
  {{HOURLY}} AS hourly_distribution FROM err WHERE {cond} GROUP BY ALL)"""


@query(
    "trend_merge",
    with_(
        "err",
        body=f""", t AS {_trend_sql_where("created_at < TIMESTAMP '2024-01-20 00:00:00'")},
b AS {_trend_sql_where("created_at >= TIMESTAMP '2024-01-15 00:00:00'")}
SELECT coalesce(t.date, b.date) AS date, coalesce(t.error_code, b.error_code) AS error_code,
  coalesce(t.status_code, b.status_code) AS status_code, coalesce(t.count, 0) + coalesce(b.count, 0) AS count,
  list_transform(range(1, 25), lambda i: CAST(coalesce(t.hourly_distribution[i], 0) + coalesce(b.hourly_distribution[i], 0) AS INT)) AS hourly_distribution
FROM t FULL OUTER JOIN b ON t.date IS NOT DISTINCT FROM b.date AND t.error_code IS NOT DISTINCT FROM b.error_code
  AND t.status_code IS NOT DISTINCT FROM b.status_code""",
    ),
)
def trend_merge(spark, sf):
    e = _err(spark, sf)
    t = TR.daily_trends(e.filter(F.col("created_at") < T.ts("2024-01-20 00:00:00")), "occurrences")
    b = TR.daily_trends(e.filter(F.col("created_at") >= T.ts("2024-01-15 00:00:00")), "occurrences")
    return J.trend_merge(t, b)


# registered fallback strategies (configuration): key -> strategy name
FALLBACKS = (("payment-gateway.process_payment", "cached_payment_status"), ("database", "read_replica"), ("email-service.send_email", "queue_for_later"))
FALLBACK_SQL = " UNION ALL ".join(f"SELECT '{k}' AS key, '{s}' AS strategy" for k, s in FALLBACKS)
TRANSIENT = (
    "coalesce(regexp_matches(message, '(?i)(timeout|connection|network|temporary|temporarily)')"
    " OR regexp_matches(message, '(503|502|504|429)'), false)"
)


@query(
    "fallback_resolution",
    with_(
        "calls",
        body=f""", reg AS ({FALLBACK_SQL}),
f AS (SELECT *, CASE WHEN operation IS NOT NULL AND operation <> '' THEN service || '.' || operation ELSE service END AS full_key FROM calls WHERE NOT ok)
SELECT seq, ts, service, operation, ok, message, coalesce(r1.strategy, r2.strategy,
  CASE WHEN {TRANSIENT} THEN 'transient_error' ELSE 'permanent_error' END) AS fallback,
  CASE WHEN r1.strategy IS NOT NULL THEN 'operation' WHEN r2.strategy IS NOT NULL THEN 'service' ELSE 'default' END AS fallback_source
FROM f LEFT JOIN reg r1 ON f.full_key = r1.key LEFT JOIN reg r2 ON f.service = r2.key""",
    ),
)
def fallback_resolution(spark, sf):
    c = T.calls(spark, sf).filter(~F.col("ok"))
    reg = spark.createDataFrame(list(FALLBACKS), "key string, strategy string")
    transient = CL.is_transient(F.col("message"), F.lit(0))
    return J.fallback_resolution(c, reg, transient)


REQ_IDS = "(SELECT id FROM err WHERE id % 97 = 0 UNION ALL SELECT -5 UNION ALL SELECT -7)"


def _req_ids(spark, sf):
    e = _err(spark, sf)
    return e.filter(F.col("id") % 97 == 0).select("id").unionByName(spark.createDataFrame([(-5,), (-7,)], "id long"))


@query("bulk_missing_ids", with_("err", body=f"SELECT DISTINCT id FROM {REQ_IDS} r WHERE id NOT IN (SELECT id FROM err)"))
def bulk_missing_ids(spark, sf):
    return J.missing_ids(_req_ids(spark, sf), _err(spark, sf))


# ---- maintenance ----------------------------------------------------------------


@query(
    "upsert_errors",
    with_(
        "err",
        body=f""", t AS (SELECT error_id, arg_min_null(id, (created_at, id)) AS id, {", ".join(f"arg_min_null({a}, (created_at, id)) AS {a}" for a in ATTRS.split(", "))},
    count(*) AS occurrence_count, min(created_at) AS first_occurred_at, max(created_at) AS last_occurred_at
  FROM err WHERE created_at < {CUT_SQL} GROUP BY error_id),
b AS (SELECT error_id, arg_min_null(id, (created_at, id)) AS id, {", ".join(f"arg_min_null({a}, (created_at, id)) AS {a}" for a in ATTRS.split(", "))},
    count(*) AS occurrence_count, min(created_at) AS first_occurred_at, max(created_at) AS last_occurred_at
  FROM err WHERE created_at >= {CUT_SQL} GROUP BY error_id)
SELECT coalesce(t.error_id, b.error_id) AS error_id, CASE WHEN t.error_id IS NOT NULL THEN t.id ELSE b.id END AS id,
  {", ".join(f"CASE WHEN t.error_id IS NOT NULL THEN t.{a} ELSE b.{a} END AS {a}" for a in ATTRS.split(", "))},
  coalesce(t.occurrence_count, 0) + coalesce(b.occurrence_count, 0) AS occurrence_count,
  least(t.first_occurred_at, b.first_occurred_at) AS first_occurred_at,
  greatest(t.last_occurred_at, b.last_occurred_at) AS last_occurred_at
FROM t FULL OUTER JOIN b ON t.error_id = b.error_id""",
    ),
)
def upsert_errors(spark, sf):
    before, after = _split(spark, sf)
    return D.upsert_errors(J.error_occurrences(before), after)


@query(
    "resolve_error",
    with_(
        "err",
        body=f""", target AS (SELECT min(id) AS tid FROM err WHERE NOT is_resolved)
SELECT * EXCLUDE (tid) REPLACE (CASE WHEN id = tid THEN true ELSE is_resolved END AS is_resolved,
  CASE WHEN id = tid THEN {A} ELSE resolved_at END AS resolved_at) FROM err, target""",
    ),
)
def resolve_error(spark, sf):
    """Resolve the oldest-id unresolved error (found with a one-row probe)."""
    e = _err(spark, sf)
    ident = e.filter(~F.col("is_resolved")).agg(F.min("id")).first()[0]
    return D.resolve_error(e, ident, AS_OF)


@query(
    "bulk_resolve",
    with_(
        "err",
        body=f"""SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit AND resolved_at IS NULL THEN true ELSE is_resolved END AS is_resolved,
  CASE WHEN hit AND resolved_at IS NULL THEN {A} ELSE resolved_at END AS resolved_at), hit AND resolved_at IS NULL AS changed
FROM (SELECT *, id IN (SELECT id FROM {REQ_IDS} r) AS hit FROM err)""",
    ),
)
def bulk_resolve(spark, sf):
    return D.bulk_resolve(_err(spark, sf), _req_ids(spark, sf), AS_OF)


@query(
    "bulk_resolve_count",
    with_("err", body=f"SELECT count(*) AS resolved FROM err WHERE id IN (SELECT id FROM {REQ_IDS} r) AND resolved_at IS NULL"),
)
def bulk_resolve_count(spark, sf):
    return D.bulk_resolve_count(D.bulk_resolve(_err(spark, sf), _req_ids(spark, sf), AS_OF))


@query("bulk_delete", with_("err", body=f"SELECT * FROM err WHERE id NOT IN (SELECT id FROM {REQ_IDS} r)"))
def bulk_delete(spark, sf):
    return D.bulk_delete(_err(spark, sf), _req_ids(spark, sf))


@query(
    "retention_purge",
    with_("err", body=f"SELECT * FROM err WHERE NOT coalesce(created_at < {A} - INTERVAL 20 DAY AND resolved_at IS NOT NULL, false)"),
)
def retention_purge(spark, sf):
    return D.retention_purge(_err(spark, sf), AS_OF, 20, "resolved")


@query(
    "breaker_reset",
    with_(
        "cb",
        body="""SELECT * REPLACE (CASE WHEN id = 7 THEN 0 ELSE failure_count END AS failure_count,
  CASE WHEN id = 7 THEN 'closed' ELSE state END AS state, CASE WHEN id = 7 THEN NULL ELSE next_attempt_at END AS next_attempt_at) FROM cb""",
    ),
)
def breaker_reset(spark, sf):
    return D.breaker_bulk_reset(T.breakers(spark, sf), ident=7)


@query(
    "breaker_bulk_reset",
    with_(
        "cb",
        body="""SELECT * REPLACE (CASE WHEN service = 'database' AND state = 'open' THEN 0 ELSE failure_count END AS failure_count,
  CASE WHEN service = 'database' AND state = 'open' THEN 'closed' ELSE state END AS state,
  CASE WHEN service = 'database' AND state = 'open' THEN NULL ELSE next_attempt_at END AS next_attempt_at) FROM cb""",
    ),
)
def breaker_bulk_reset(spark, sf):
    return D.breaker_bulk_reset(T.breakers(spark, sf), service="database", state="open")


@query(
    "breaker_auto_reset",
    with_(
        "cb",
        body=f"""SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN 'closed' ELSE state END AS state, CASE WHEN h THEN 0 ELSE failure_count END AS failure_count,
  CASE WHEN h THEN NULL ELSE opened_at END AS opened_at, CASE WHEN h THEN NULL ELSE next_attempt_at END AS next_attempt_at)
FROM (SELECT *, coalesce(state = 'open' AND next_attempt_at < {A}, false) AS h FROM cb)""",
    ),
)
def breaker_auto_reset(spark, sf):
    return D.breaker_auto_reset(T.breakers(spark, sf), AS_OF)


@query(
    "breaker_record_failure",
    with_(
        "cb",
        body=f"""SELECT * EXCLUDE (hit, trip) REPLACE (CASE WHEN hit THEN failure_count + 1 ELSE failure_count END AS failure_count,
  CASE WHEN hit THEN {A} ELSE last_failure_at END AS last_failure_at, CASE WHEN trip THEN 'open' ELSE state END AS state,
  CASE WHEN trip THEN {A} ELSE opened_at END AS opened_at,
  CASE WHEN trip THEN {A} + recovery_timeout * INTERVAL 1 SECOND ELSE next_attempt_at END AS next_attempt_at)
FROM (SELECT *, service = 'database' AS hit, service = 'database' AND failure_count + 1 >= failure_threshold AS trip FROM cb)""",
    ),
)
def breaker_record_failure(spark, sf):
    return D.breaker_record(T.breakers(spark, sf), F.col("service") == "database", ok=False, as_of=AS_OF)


@query(
    "breaker_record_success",
    with_(
        "cb",
        body=f"""SELECT * EXCLUDE (c, h) REPLACE (CASE WHEN c THEN 'closed' WHEN h THEN 'half_open' ELSE state END AS state,
  CASE WHEN c THEN 0 ELSE failure_count END AS failure_count)
FROM (SELECT *, service = 'api-service' AND state = 'half_open' AS c,
  service = 'api-service' AND state = 'open' AND coalesce(next_attempt_at < {A}, false) AS h FROM cb)""",
    ),
)
def breaker_record_success(spark, sf):
    return D.breaker_record(T.breakers(spark, sf), F.col("service") == "api-service", ok=True, as_of=AS_OF)
