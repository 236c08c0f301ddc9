"""Registered breaker replay queries (X2, X3, X4, X8) with a DuckDB
recursive-CTE oracle that folds each key's calls one by one."""

from __future__ import annotations

from faultline import config as C
from faultline.operators import breaker as B
from faultline.plans.oracle import CALLS
from faultline.plans.registry import query
from faultline.sources import tables as T

# test parameters: threshold 5, recovery 6 hours (calls are about an hour apart)
CFG = C.BreakerConfig(failure_threshold=5, recovery_timeout_s=6 * 3600)
TH, REC = CFG.failure_threshold, CFG.recovery_timeout_s

FOLD = f"""WITH RECURSIVE {CALLS},
c AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY service, operation) AS kid,
  row_number() OVER (PARTITION BY service, operation ORDER BY ts, seq) AS rn FROM calls),
fold AS (
  SELECT service, operation, kid, CAST(0 AS BIGINT) AS rn, 'closed' AS state, 0 AS f, CAST(NULL AS TIMESTAMP) AS nxt,
    CAST(NULL AS TIMESTAMP) AS opened, CAST(NULL AS TIMESTAMP) AS lastf, CAST(NULL AS VARCHAR) AS disp,
    0 AS trips, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BOOLEAN) AS ok,
    CAST(NULL AS VARCHAR) AS prev_state
  FROM (SELECT DISTINCT service, operation, kid FROM c) k
  UNION ALL
  SELECT x.service, x.operation, x.kid, x.crn,
    CASE WHEN NOT x.allowed THEN x.state
         WHEN x.cok THEN CASE WHEN x.state = 'half_open' THEN 'closed' WHEN x.state = 'open' THEN 'half_open' ELSE x.state END
         WHEN x.f + 1 >= {TH} THEN 'open' ELSE x.state END,
    CASE WHEN NOT x.allowed THEN x.f WHEN x.cok THEN CASE WHEN x.state = 'half_open' THEN 0 ELSE x.f END ELSE x.f + 1 END,
    CASE WHEN x.allowed AND NOT x.cok AND x.f + 1 >= {TH} THEN x.cts + INTERVAL {REC} SECOND ELSE x.nxt END,
    CASE WHEN x.allowed AND NOT x.cok AND x.f + 1 >= {TH} THEN x.cts ELSE x.opened END,
    CASE WHEN x.allowed AND NOT x.cok THEN x.cts ELSE x.lastf END,
    CASE WHEN NOT x.allowed THEN 'rejected' WHEN x.cok THEN 'ok' ELSE 'failed' END,
    x.trips + CASE WHEN x.allowed AND NOT x.cok AND x.f + 1 >= {TH} THEN 1 ELSE 0 END,
    x.cseq, x.cts, x.cok, x.state
  FROM (
    SELECT fo.*, c.rn AS crn, c.seq AS cseq, c.ts AS cts, c.ok AS cok,
      fo.state IN ('closed', 'half_open') OR (fo.state = 'open' AND fo.nxt < c.ts) AS allowed
    FROM fold fo JOIN c ON c.kid = fo.kid AND c.rn = fo.rn + 1
  ) x
)"""

FOLD_SQL = (
    FOLD
    + """
SELECT service, operation, arg_max(state, rn) AS state, CAST(arg_max(f, rn) AS BIGINT) AS failure_count,
  arg_max(lastf, rn) AS last_failure_at, arg_max(opened, rn) AS opened_at, arg_max(nxt, rn) AS next_attempt_at,
  count(*) FILTER (WHERE rn > 0) AS calls, count(*) FILTER (WHERE disp = 'rejected') AS rejected,
  CAST(arg_max(trips, rn) AS BIGINT) AS trips
FROM fold GROUP BY service, operation"""
)

# registered fallback strategies (configuration): key -> strategy name
FALLBACKS = (("payment-gateway.process_payment", "cached_payment_status"), ("database", "read_replica"))
REG_SQL = " UNION ALL ".join(f"SELECT '{k}' AS key, '{v}' AS strategy" for k, v in FALLBACKS)
TRANSIENT = (
    "coalesce(regexp_matches(em, '(?i)(timeout|connection|network|temporary|temporarily)')"
    " OR regexp_matches(em, '(503|502|504|429)'), false)"
)
GUARDED_SQL = (
    FOLD
    + f""",
reg AS ({REG_SQL}),
d AS (SELECT fo.seq, fo.ts, fo.service, fo.operation, fo.ok, c.message, fo.disp AS disposition,
    CASE WHEN fo.disp = 'rejected' THEN 'Circuit breaker is open' ELSE c.message END AS em,
    CASE WHEN fo.operation IS NOT NULL AND fo.operation <> '' THEN fo.service || '.' || fo.operation ELSE fo.service END AS full_key
  FROM fold fo JOIN c ON c.seq = fo.seq WHERE fo.rn > 0)
SELECT seq, ts, service, operation, ok, message, disposition,
  CASE WHEN disposition = 'ok' THEN NULL ELSE coalesce(r1.strategy, r2.strategy,
    CASE WHEN {TRANSIENT} THEN 'transient_error' ELSE 'permanent_error' END) END AS fallback,
  CASE WHEN disposition = 'ok' THEN NULL WHEN r1.strategy IS NOT NULL THEN 'operation' WHEN r2.strategy IS NOT NULL THEN 'service'
    ELSE 'default' END AS fallback_source
FROM d LEFT JOIN reg r1 ON d.full_key = r1.key LEFT JOIN reg r2 ON d.service = r2.key"""
)

HISTORY_SQL = (
    FOLD
    + """
SELECT service, operation, ts, prev_state AS from_state, state AS to_state, CAST(f AS BIGINT) AS failure_count
FROM fold WHERE rn > 0 AND state <> prev_state
UNION ALL
SELECT service, operation, ts, 'open' AS from_state, 'open' AS to_state, CAST(f AS BIGINT) AS failure_count
FROM fold WHERE rn > 0 AND state = 'open' AND prev_state = 'open' AND disp = 'failed'"""
)


def _calls(spark, sf):
    return T.calls(spark, sf).select("seq", "ts", "service", "operation", "ok")


@query("breaker_fold", FOLD_SQL)
def breaker_fold(spark, sf):
    return B.breaker_fold(_calls(spark, sf), CFG)


@query("guarded_calls", GUARDED_SQL)
def guarded_calls(spark, sf):
    reg = spark.createDataFrame(list(FALLBACKS), "key string, strategy string")
    return B.guarded_calls(T.calls(spark, sf), CFG, reg)


@query("breaker_history", HISTORY_SQL)
def breaker_history(spark, sf):
    return B.breaker_history(_calls(spark, sf), CFG)


@query(
    "breaker_first_trip",
    f"""WITH {CALLS},
r AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY service, operation ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS cf FROM calls)
SELECT service, operation, ts AS first_trip_at, seq FROM r WHERE NOT ok AND cf = {TH}""",
)
def breaker_first_trip(spark, sf):
    return B.breaker_first_trip(_calls(spark, sf), CFG)
