"""DuckDB twins of the table adapters, used by ``oracle_sql()``.

Each oracle query is ``WITH <adapter CTEs> <select>`` over the driver views.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

ERR = """err AS (
  SELECT event_id AS id,
    concat('err_', event_type, '_', CAST(k AS VARCHAR)) AS error_id,
    list_extract(list_value('ValidationException','AuthenticationException','AuthorizationException',
      'NotFoundHttpException','AccessDeniedHttpException','Exception'), k % 6 + 1) AS exception_class,
    CASE WHEN k % 10 < 3 THEN NULL ELSE list_extract(list_value('VALIDATION_FAILED','UNAUTHORIZED','FORBIDDEN',
      'NOT_FOUND','INTERNAL_ERROR','RATE_LIMIT_EXCEEDED'), k % 6 + 1) END AS error_code,
    concat(list_extract(list_value('Connection timeout','Connection failed','API rate_limit exceeded',
      'Authentication failed','Validation failed','Unknown error','HTTP 503 error','Network error'), k % 8 + 1),
      ' in ', event_type) AS message,
    list_extract(list_value(400,401,403,404,422,429,500,502,503), k % 9 + 1) AS status_code,
    list_extract(list_value('GET','POST','PUT','DELETE','PATCH'), CAST(event_id % 5 + 1 AS INT)) AS request_method,
    concat('https://api.example.test/', event_type, '/', CAST(k % 20 AS VARCHAR)) AS request_url,
    CASE WHEN event_id % 10 < 6 THEN CAST(user_id AS VARCHAR) END AS user_id,
    k % 5 = 0 AS is_resolved, k % 10 + 1 AS occurrence_count, value AS response_ms,
    ts AS created_at, ts AS updated_at,
    CASE WHEN k % 5 = 0 THEN ts + INTERVAL 1 HOUR END AS resolved_at,
    concat('10.', k, '.', event_id % 256, '.7') AS ip_address,
    list_extract(list_value('Mozilla/5.0','curl/8.5','okhttp/4.12'), k % 3 + 1) AS user_agent
  FROM (SELECT e.*, CAST(json_extract(props, '$.k') AS INT) AS k FROM events e) x
)"""

CALLS = """calls AS (
  SELECT event_id AS seq, ts,
    list_extract(list_value('api-service','database','payment-gateway','email-service','storage-service'), k % 5 + 1) AS service,
    CASE WHEN user_id % 5 < 2 THEN NULL ELSE list_extract(list_value('create_user','process_payment','send_email',
      'upload_file','fetch_data'), CAST(user_id % 5 + 1 AS INT)) END AS operation,
    event_type <> 'error' AS ok,
    list_extract(list_value('Connection timeout','Connection failed','API rate_limit exceeded',
      'Authentication failed','Validation failed','Unknown error','HTTP 503 error','Network error'), k % 8 + 1) AS message
  FROM (SELECT e.*, CAST(json_extract(props, '$.k') AS INT) AS k FROM events e) x
)"""

CB = """cb AS (
  SELECT s_suppkey AS id,
    list_extract(list_value('api-service','database','payment-gateway','email-service','storage-service'), CAST(s_suppkey % 5 + 1 AS INT)) AS service,
    CASE WHEN s_suppkey % 10 < 4 THEN NULL ELSE concat('op_', CAST(s_suppkey AS VARCHAR)) END AS operation,
    list_extract(list_value('closed','open','half_open'), s_nationkey % 3 + 1) AS state,
    CASE WHEN s_nationkey % 3 = 0 THEN 0 ELSE CAST(s_suppkey % 10 + 1 AS INT) END AS failure_count,
    s_nationkey % 5 + 3 AS failure_threshold,
    CAST(s_suppkey % 91 + 30 AS INT) AS recovery_timeout,
    s_nationkey % 4 + 2 AS success_threshold,
    CASE WHEN s_nationkey % 3 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - CAST(s_suppkey % 120 AS INT) * INTERVAL 1 MINUTE END AS last_failure_at,
    CASE WHEN s_nationkey % 3 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - CAST(s_suppkey % 120 AS INT) * INTERVAL 1 MINUTE END AS opened_at,
    CASE WHEN s_nationkey % 3 = 1 THEN TIMESTAMP '2024-01-31 00:00:00' + CAST(s_suppkey % 121 - 60 AS INT) * INTERVAL 1 SECOND END AS next_attempt_at,
    TIMESTAMP '2024-01-31 00:00:00' - CAST(s_suppkey AS INT) * INTERVAL 1 MINUTE AS updated_at
  FROM supplier
)"""

ATTEMPTS = """attempts AS (
  SELECT l_orderkey AS call_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey,
      l_quantity, l_extendedprice) AS attempt_no,
    l_partkey % 3 = 0 AS ok,
    list_extract(list_value(429,500,502,503,422), CAST(l_suppkey % 5 + 1 AS INT)) AS status_code,
    list_extract(list_value('Connection timeout','Invalid data','Network error','HTTP 503 error'),
      CAST(l_partkey % 4 + 1 AS INT)) AS message,
    l_shipdate AS ts
  FROM lineitem
)"""

# errors rolled up per error_id (A12): first sighting's attributes.
ROLLUP = """rollup AS (
  SELECT error_id,
    arg_min_null(exception_class, (created_at, id)) AS exception_class,
    arg_min_null(error_code, (created_at, id)) AS error_code,
    arg_min_null(message, (created_at, id)) AS message,
    arg_min_null(status_code, (created_at, id)) AS status_code,
    arg_min_null(request_method, (created_at, id)) AS request_method,
    arg_min_null(request_url, (created_at, id)) AS request_url,
    arg_min_null(user_id, (created_at, id)) AS user_id,
    arg_min_null(id, (created_at, id)) AS id,
    CAST(count(*) AS BIGINT) AS occurrence_count,
    min(created_at) AS first_occurred_at,
    max(created_at) AS last_occurred_at
  FROM err GROUP BY error_id
)"""

HOURLY_SQL = "[" + ", ".join(f"CAST(count(*) FILTER (WHERE hour(created_at) = {h}) AS INT)" for h in range(24)) + "]"

CTES = {"err": ERR, "calls": CALLS, "cb": CB, "attempts": ATTEMPTS, "rollup": ROLLUP}
DEPENDS = {"rollup": ("err",)}


def with_(*names: str, body: str) -> str:
    """Compose ``WITH`` clauses for the named adapters followed by ``body``."""
    order: list[str] = []
    for n in names:
        for d in DEPENDS.get(n, ()):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    body = body.replace("{HOURLY}", HOURLY_SQL)
    return "WITH " + ",\n".join(CTES[n] for n in order) + "\n" + body
