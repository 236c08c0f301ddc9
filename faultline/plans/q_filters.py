"""Registered filter queries (P1-P21) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import filters as P
from faultline.plans.oracle import with_
from faultline.plans.registry import query
from faultline.sources import tables as T

AS_OF = T.AS_OF
A = "TIMESTAMP '2024-01-31 00:00:00'"


def _err(spark, sf):
    return T.errors(spark, sf)


@query("errors_unresolved", with_("err", body="SELECT * FROM err WHERE NOT is_resolved"))
def errors_unresolved(spark, sf):
    return P.unresolved(_err(spark, sf))


@query("errors_resolved", with_("err", body="SELECT * FROM err WHERE is_resolved"))
def errors_resolved(spark, sf):
    return P.resolved(_err(spark, sf))


@query("errors_by_status_code", with_("err", body="SELECT * FROM err WHERE status_code = 503"))
def errors_by_status_code(spark, sf):
    return P.by_status_code(_err(spark, sf), 503)


@query("errors_by_error_code", with_("err", body="SELECT * FROM err WHERE error_code = 'RATE_LIMIT_EXCEEDED'"))
def errors_by_error_code(spark, sf):
    return P.by_error_code(_err(spark, sf), "RATE_LIMIT_EXCEEDED")


@query("errors_recent", with_("err", body=f"SELECT * FROM err WHERE created_at >= {A} - INTERVAL 24 HOUR"))
def errors_recent(spark, sf):
    return P.recent(_err(spark, sf), AS_OF, 24)


@query(
    "search_errors",
    with_(
        "err",
        body="""SELECT * FROM err WHERE coalesce(contains(lower(message), 'timeout'), false)
  OR coalesce(contains(lower(request_url), 'timeout'), false)
  OR coalesce(contains(lower(error_code), 'timeout'), false)""",
    ),
)
def search_errors(spark, sf):
    return P.search(_err(spark, sf), "Timeout")


@query(
    "errors_date_range",
    with_(
        "err",
        body="SELECT * FROM err WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'",
    ),
)
def errors_date_range(spark, sf):
    return P.date_range(_err(spark, sf), "2024-01-10", "2024-01-20")


# page 2 of 25 of unresolved 429s that mention "rate", newest first
@query(
    "errors_page",
    with_(
        "err",
        body="""SELECT * FROM err WHERE NOT is_resolved AND status_code = 429
  AND (coalesce(contains(lower(message), 'rate'), false) OR coalesce(contains(lower(request_url), 'rate'), false)
       OR coalesce(contains(lower(error_code), 'rate'), false))
  AND created_at >= TIMESTAMP '2024-01-05 00:00:00'
ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 25""",
    ),
)
def errors_page(spark, sf):
    f = {"status": "unresolved", "status_code": 429, "search": "rate", "from_date": "2024-01-05", "to_date": None}
    return P.page(_err(spark, sf), f, page_no=2, per_page=25)


@query("error_detail", with_("err", body="SELECT * FROM err WHERE id = 42"))
def error_detail(spark, sf):
    return P.by_id_or_fail(_err(spark, sf), 42, "error")


@query(
    "breakers_filtered",
    with_("cb", body="SELECT * FROM cb WHERE state = 'open' AND contains(service, 'service')"),
)
def breakers_filtered(spark, sf):
    return P.breakers_filtered(T.breakers(spark, sf), state="open", service="service")


@query("breakers_to_reset", with_("cb", body="SELECT * FROM cb WHERE service = 'database' AND state = 'half_open'"))
def breakers_to_reset(spark, sf):
    return P.breakers_to_reset(T.breakers(spark, sf), service="database", state="half_open")


@query(
    "breakers_unhealthy",
    with_("cb", body="SELECT service, operation, state, failure_count, next_attempt_at, "
         "coalesce(state = 'half_open' OR next_attempt_at < TIMESTAMP '2024-01-31 00:00:00', false) AS can_attempt FROM cb WHERE state <> 'closed'"),
)
def breakers_unhealthy(spark, sf):
    return P.breakers_unhealthy(T.breakers(spark, sf), T.AS_OF)


@query(
    "errors_by_ids",
    with_("err", body="SELECT * FROM err WHERE id IN (SELECT id FROM err WHERE id % 97 = 0 UNION ALL SELECT -5)"),
)
def errors_by_ids(spark, sf):
    e = _err(spark, sf)
    ids = e.filter(F.col("id") % 97 == 0).select("id").unionByName(spark.range(-5, -4).select("id"))
    return P.by_ids(e, ids)


@query(
    "retention_candidates",
    with_(
        "err",
        body=f"SELECT * FROM err WHERE created_at < {A} - INTERVAL 20 DAY AND resolved_at IS NOT NULL",
    ),
)
def retention_candidates(spark, sf):
    return P.retention_candidates(_err(spark, sf), AS_OF, 20, "resolved")


@query("critical_errors", with_("err", body="SELECT * FROM err WHERE status_code IN (500, 502)"))
def critical_errors(spark, sf):
    return P.critical(_err(spark, sf))


@query(
    "critical_recent_unresolved",
    with_(
        "err",
        body=f"SELECT * FROM err WHERE status_code >= 500 AND created_at >= {A} - INTERVAL 24 HOUR AND NOT is_resolved",
    ),
)
def critical_recent_unresolved(spark, sf):
    return P.critical_recent_unresolved(_err(spark, sf), AS_OF, 24)


@query(
    "recoverable_requests",
    with_(
        "err",
        body="""SELECT * FROM err WHERE request_method IN ('GET','HEAD') AND (
  contains(lower(message), 'timeout') OR contains(lower(message), 'connection')
  OR contains(lower(message), 'rate_limit') OR status_code IN (429, 502, 503, 504))""",
    ),
)
def recoverable_requests(spark, sf):
    return P.recoverable_requests(_err(spark, sf))


@query(
    "breakers_stuck_open",
    with_("cb", body=f"SELECT * FROM cb WHERE state = 'open' AND opened_at < {A} - INTERVAL 30 MINUTE"),
)
def breakers_stuck_open(spark, sf):
    return P.breakers_stuck_open(T.breakers(spark, sf), AS_OF, 30)


@query("errors_page_total", with_("err", body="SELECT count(*) AS total FROM err WHERE status_code = 500 AND NOT is_resolved"))
def errors_page_total(spark, sf):
    return P.page_total(_err(spark, sf), {"status_code": 500, "status": "unresolved"})
