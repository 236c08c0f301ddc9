"""Registered row-shape queries."""

from __future__ import annotations

from faultline.functions.formatting import relative_sql
from faultline.operators import shapes as SH
from faultline.plans.oracle import with_
from faultline.plans.registry import query
from faultline.sources import tables as T

AS_OF = T.AS_OF
A = "TIMESTAMP '2024-01-31 00:00:00'"


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def trunc(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '...' ELSE {c} END"


@query(
    "list_json_rows",
    with_(
        "err",
        body=f"""SELECT error_id, message, status_code, occurrence_count, resolved_at IS NOT NULL AS resolved,
  {iso('updated_at')} AS last_seen, request_url AS endpoint FROM err""",
    ),
)
def list_json_rows(spark, sf):
    return SH.list_json_rows(T.errors(spark, sf))


@query(
    "list_table_rows",
    with_(
        "err",
        body=f"""SELECT substring(error_id, 1, 12) || '...' AS error_id, {trunc('message', 40)} AS message, status_code,
  occurrence_count, {relative_sql('updated_at', A)} AS last_seen,
  CASE WHEN resolved_at IS NOT NULL THEN '✓ Resolved' ELSE 'Open' END AS status FROM err""",
    ),
)
def list_table_rows(spark, sf):
    return SH.list_table_rows(T.errors(spark, sf), AS_OF)


@query(
    "list_compact_rows",
    with_(
        "err",
        body=f"""SELECT id, CASE WHEN resolved_at IS NOT NULL THEN '✓' ELSE '✗' END || ' [' || CAST(status_code AS VARCHAR) || '] '
  || {trunc('message', 60)} || ' (×' || CAST(occurrence_count AS VARCHAR) || ') - ' || {relative_sql('updated_at', A)} AS line FROM err""",
    ),
)
def list_compact_rows(spark, sf):
    return SH.list_compact_rows(T.errors(spark, sf), AS_OF)


IDENT = "concat_ws(':', 'circuit_breaker', service, nullif(operation, ''))"


@query(
    "breaker_json_rows",
    with_(
        "cb",
        body=f"""SELECT id, {IDENT} AS identifier, service, state, failure_count, failure_threshold, success_threshold,
  {iso('last_failure_at')} AS last_failure_at, {iso('next_attempt_at')} AS next_attempt_at FROM cb""",
    ),
)
def breaker_json_rows(spark, sf):
    return SH.breaker_json_rows(T.breakers(spark, sf))


@query(
    "breaker_table_rows",
    with_(
        "cb",
        body=f"""SELECT id, substring({IDENT}, 1, 20) AS identifier, service, upper(state) AS state,
  CAST(failure_count AS VARCHAR) || '/' || CAST(failure_threshold AS VARCHAR) AS failures,
  coalesce({relative_sql('last_failure_at', A)}, 'Never') AS last_failure,
  coalesce({relative_sql('next_attempt_at', A)}, 'N/A') AS next_attempt,
  service || ' (' || state || ') - F:' || CAST(failure_count AS VARCHAR) || '/' || CAST(failure_threshold AS VARCHAR) AS compact
FROM cb""",
    ),
)
def breaker_table_rows(spark, sf):
    return SH.breaker_table_rows(T.breakers(spark, sf), AS_OF)


@query(
    "breaker_status",
    with_(
        "cb",
        body=f"""SELECT service, operation, state, failure_count, failure_threshold,
  coalesce(state IN ('closed', 'half_open') OR (state = 'open' AND next_attempt_at < {A}), false) AS can_attempt,
  strftime(next_attempt_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS next_attempt_at FROM cb""",
    ),
)
def breaker_status(spark, sf):
    return SH.breaker_status(T.breakers(spark, sf), AS_OF)
