"""Registered retry queries."""

from __future__ import annotations

from faultline.operators import retry as RT
from faultline.plans.oracle import with_
from faultline.plans.registry import query
from faultline.sources import tables as T

TRANSIENT = (
    "coalesce(regexp_matches(message, '(?i)(timeout|connection|network|temporary|temporarily)')"
    " OR regexp_matches(message, '(503|502|504|429)') OR status_code IN (429, 502, 503, 504), false)"
)


@query(
    "retry_outcomes",
    with_(
        "attempts",
        body=f""", a AS (SELECT *, {TRANSIENT} AS transient FROM attempts WHERE attempt_no <= 3),
s AS (SELECT call_id, count(*) AS logged, min(attempt_no) FILTER (WHERE ok OR NOT transient OR attempt_no = 3) AS stop_at FROM a GROUP BY 1),
j AS (SELECT s.*, a.ok, a.transient FROM s LEFT JOIN a ON a.call_id = s.call_id AND a.attempt_no = s.stop_at),
t AS (SELECT *, CAST(coalesce(stop_at, logged) AS INT) AS tries,
  CASE WHEN stop_at IS NULL THEN 'incomplete' WHEN ok THEN 'success' WHEN NOT transient THEN 'failed' ELSE 'max_retries' END AS outcome,
  CASE WHEN stop_at IS NOT NULL THEN coalesce(stop_at, logged) - 1 ELSE logged END AS sleeps FROM j)
SELECT call_id, tries, outcome, round(CASE WHEN sleeps > 0 THEN list_sum(list_transform(range(1, sleeps + 1), lambda i: 1000.0 * pow(2.0, i - 1))) ELSE 0.0 END, 3) AS backoff_ms
FROM t""",
    ),
)
def retry_outcomes(spark, sf):
    return RT.retry_outcomes(T.attempts(spark, sf))


# per-service retry strategies (configuration)
STRATEGIES = (("payment-gateway", 5, 500, 2.0), ("email-service", 2, 2000, 1.5))
STRAT_SQL = " UNION ALL ".join(f"SELECT '{s}' AS service, {m} AS max_retries, {b} AS base_delay_ms, {x} AS multiplier" for s, m, b, x in STRATEGIES)


@query(
    "backoff_schedule",
    with_(
        "calls",
        body=f""", st AS ({STRAT_SQL}),
s AS (SELECT DISTINCT calls.service, coalesce(max_retries, 3) AS mx, coalesce(CAST(base_delay_ms AS DOUBLE), 1000.0) AS b,
  coalesce(CAST(multiplier AS DOUBLE), 2.0) AS m FROM calls LEFT JOIN st ON st.service = calls.service)
SELECT service, CAST(retry_no AS INT) AS retry_no, round(b * pow(m, retry_no - 1), 3) AS delay_ms
FROM (SELECT *, unnest(range(1, mx)) AS retry_no FROM s)""",
    ),
)
def backoff_schedule(spark, sf):
    strategies = spark.createDataFrame(list(STRATEGIES), "service string, max_retries int, base_delay_ms int, multiplier double")
    return RT.backoff_schedule(T.calls(spark, sf), strategies)
