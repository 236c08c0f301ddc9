"""Registered classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import classify as CL
from faultline.operators import render as RN
from faultline.plans.oracle import with_
from faultline.plans.registry import query
from faultline.sources import tables as T

AS_OF = T.AS_OF
A = "TIMESTAMP '2024-01-31 00:00:00'"


def _err(spark, sf):
    return T.errors(spark, sf)


@query(
    "status_severity",
    with_(
        "err",
        body="SELECT id, status_code, CASE WHEN status_code >= 500 THEN 'red' WHEN status_code >= 400 THEN 'yellow' ELSE 'green' END AS severity FROM err",
    ),
)
def status_severity(spark, sf):
    return _err(spark, sf).select("id", "status_code", CL.status_severity(F.col("status_code")).alias("severity"))


TITLES_SQL = "CASE " + " ".join(f"WHEN {{s}} = {c} THEN '{t}'" for c, t in C.STATUS_TITLES) + " ELSE 'Error' END"


def title_sql(col: str) -> str:
    return TITLES_SQL.format(s=col)


@query("status_titles", with_("err", body=f"SELECT id, status_code, {title_sql('status_code')} AS title FROM err"))
def status_titles(spark, sf):
    return _err(spark, sf).select("id", "status_code", CL.status_title(F.col("status_code")).alias("title"))


DERIVED_SQL = (
    "lower(regexp_replace(replace(list_last(string_split({c}, '\\')), 'Exception', ''), '(.)([A-Z])', '\\1_\\2', 'g'))"
)


def derived_sql(col: str) -> str:
    return DERIVED_SQL.format(c=col)


@query("derived_error_code", with_("err", body=f"SELECT id, exception_class, {derived_sql('exception_class')} AS derived_code FROM err"))
def derived_error_code(spark, sf):
    return _err(spark, sf).select("id", "exception_class", CL.derived_error_code(F.col("exception_class")).alias("derived_code"))


@query(
    "problem_type_uri",
    with_(
        "err",
        body=f"""SELECT id, 'https://api.example.com/errors/' || lower(replace(coalesce(error_code, {derived_sql('exception_class')}), '_', '-')) AS type
FROM err""",
    ),
)
def problem_type_uri(spark, sf):
    e = _err(spark, sf)
    code = F.coalesce(F.col("error_code"), CL.derived_error_code(F.col("exception_class")))
    return e.select("id", CL.problem_type_uri(code).alias("type"))


CATEGORY_SQL = """CASE WHEN list_last(string_split({x}, '\\')) = 'ValidationException' THEN 'validation'
  WHEN {s} = 401 THEN 'authentication' WHEN {s} = 403 THEN 'authorization' WHEN {s} = 404 THEN 'not_found'
  WHEN {s} = 429 THEN 'rate_limit' WHEN {s} >= 500 THEN 'internal' WHEN {s} >= 400 THEN 'client' ELSE 'unknown' END"""


def category_sql(status: str, cls: str) -> str:
    return CATEGORY_SQL.format(s=status, x=cls)


@query("error_category", with_("err", body=f"SELECT id, status_code, {category_sql('status_code', 'exception_class')} AS category FROM err"))
def error_category(spark, sf):
    e = _err(spark, sf)
    return e.select("id", "status_code", CL.error_category(F.col("status_code"), F.col("exception_class")).alias("category"))


CAT_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS category, {code} AS code" for name, codes in C.CATEGORIES for code in codes
)


@query(
    "category_membership",
    with_("err", body=f", cats AS ({CAT_ROWS}) SELECT id, status_code, category FROM err JOIN cats ON cats.code = err.status_code"),
)
def category_membership(spark, sf):
    e = _err(spark, sf)
    return e.select("id", "status_code", F.explode(CL.category_list(F.col("status_code"))).alias("category"))


VAL_SRC = f"""v AS (SELECT event_id AS id, MAP {{
    list_extract({list(T.VALIDATION_FIELDS_A)}, k % 4 + 1):
      [list_extract({list(T.VALIDATION_MESSAGES_A)}, k % 5 + 1), list_extract({list(T.VALIDATION_MESSAGES_B)}, k % 3 + 1)],
    list_extract({list(T.VALIDATION_FIELDS_B)}, CAST(user_id % 4 + 1 AS INT)):
      [list_extract({list(T.VALIDATION_MESSAGES_A)}, (k + 2) % 5 + 1)] }} AS errors
  FROM (SELECT e.*, CAST(json_extract(props, '$.k') AS INT) AS k FROM events e) x WHERE k % 9 = 4)"""

VALCODE_SQL = (
    "CASE WHEN contains({m}, 'required') THEN 'FIELD_REQUIRED' WHEN contains({m}, 'email') THEN 'INVALID_EMAIL'"
    " WHEN contains({m}, 'numeric') THEN 'MUST_BE_NUMERIC' WHEN contains({m}, 'string') THEN 'MUST_BE_STRING'"
    " ELSE 'VALIDATION_ERROR' END"
)

FANOUT_SQL = f"""WITH {VAL_SRC},
f AS (SELECT id, unnest(map_keys(errors)) AS field, unnest(map_values(errors)) AS messages FROM v),
m AS (SELECT id, field, unnest(messages) AS message, unnest(range(1, len(messages) + 1)) AS pos FROM f)
SELECT id, field, CAST(pos AS INTEGER) AS pos, '422' AS status, {VALCODE_SQL.format(m='message')} AS code, 'Validation Error' AS title,
  message AS detail, '/data/attributes/' || replace(field, '.', '/') AS pointer FROM m"""


@query("validation_fanout", FANOUT_SQL)
def validation_fanout(spark, sf):
    return RN.validation_fanout(T.validation_errors(spark, sf))


@query(
    "validation_codes",
    f"""WITH {VAL_SRC},
f AS (SELECT id, unnest(map_keys(errors)) AS field, unnest(map_values(errors)) AS messages FROM v)
SELECT id, field, message, {VALCODE_SQL.format(m='message')} AS code FROM (SELECT id, field, unnest(messages) AS message FROM f)""",
)
def validation_codes(spark, sf):
    v = T.validation_errors(spark, sf)
    x = v.select("id", F.explode("errors").alias("field", "messages")).select("id", "field", F.explode("messages").alias("message"))
    return x.select("id", "field", "message", CL.validation_code(F.col("message")).alias("code"))


@query(
    "json_pointer",
    f"""WITH {VAL_SRC}
SELECT id, field, '/data/attributes/' || replace(field, '.', '/') AS pointer FROM (SELECT id, unnest(map_keys(errors)) AS field FROM v)""",
)
def json_pointer(spark, sf):
    v = T.validation_errors(spark, sf)
    x = v.select("id", F.explode(F.map_keys("errors")).alias("field"))
    return x.select("id", "field", CL.json_pointer(F.col("field")).alias("pointer"))


@query(
    "validation_summary",
    f"""WITH {VAL_SRC},
f AS (SELECT id, unnest(map_keys(errors)) AS field, unnest(map_values(errors)) AS messages FROM v)
SELECT id, field, coalesce(messages[1], 'Validation failed') AS message, {VALCODE_SQL.format(m="coalesce(messages[1], '')")} AS code FROM f""",
)
def validation_summary(spark, sf):
    s = RN.validation_summary(T.validation_errors(spark, sf))
    return s.select("id", F.explode("summary").alias("field", "v")).select("id", "field", "v.message", "v.code")


TRANSIENT_SQL = (
    "coalesce(regexp_matches({m}, '(?i)(timeout|connection|network|temporary|temporarily)')"
    " OR regexp_matches({m}, '(503|502|504|429)') OR {s} IN (429, 502, 503, 504), false)"
)


def transient_sql(m: str, s: str) -> str:
    return TRANSIENT_SQL.format(m=m, s=s)


@query("transient_errors", with_("err", body=f"SELECT * FROM err WHERE {transient_sql('message', 'status_code')}"))
def transient_errors(spark, sf):
    return _err(spark, sf).filter(CL.is_transient(F.col("message"), F.col("status_code")))


def _sugg_case(field: int) -> str:
    rows = list(C.SUGGESTIONS)
    parts = []
    for key, msg, acts in rows:
        val = f"'{key}'" if field == 0 else (f"'{msg}'" if field == 1 else "[" + ", ".join(f"'{a}'" for a in acts) + "]")
        parts.append(f"WHEN contains(lower(message), '{key}') THEN {val}")
    g = C.GENERAL_SUGGESTION
    nr = C.NON_RECOVERABLE_SUGGESTION
    gval = [f"'{g[0]}'", f"'{g[1]}'", "[" + ", ".join(f"'{a}'" for a in g[2]) + "]"][field]
    nval = [f"'{nr[0]}'", f"'{nr[1]}'", "[" + ", ".join(f"'{a}'" for a in nr[2]) + "]"][field]
    return f"CASE WHEN NOT ({transient_sql('message', 'status_code')}) THEN {nval} " + " ".join(parts) + f" ELSE {gval} END"


@query(
    "recovery_suggestions",
    with_(
        "err",
        body=f"SELECT id, {_sugg_case(0)} AS type, {_sugg_case(1)} AS suggestion, {_sugg_case(2)} AS actions FROM err",
    ),
)
def recovery_suggestions(spark, sf):
    e = _err(spark, sf)
    s = CL.recovery_suggestion(F.col("message"), CL.is_transient(F.col("message"), F.col("status_code")))
    return e.select("id", s.getField("type").alias("type"), s.getField("message").alias("suggestion"), s.getField("actions").alias("actions"))


@query(
    "breaker_can_attempt",
    with_(
        "cb",
        body=f"""SELECT id, coalesce(state IN ('closed', 'half_open') OR (state = 'open' AND next_attempt_at < {A}), false) AS can_attempt,
  coalesce(state = 'open' AND next_attempt_at > {A}, false) AS is_open FROM cb""",
    ),
)
def breaker_can_attempt(spark, sf):
    cb = T.breakers(spark, sf)
    t = T.ts(AS_OF)
    return cb.select(
        "id",
        CL.can_attempt(F.col("state"), F.col("next_attempt_at"), t).alias("can_attempt"),
        CL.is_open(F.col("state"), F.col("next_attempt_at"), t).alias("is_open"),
    )


@query(
    "breaker_retry_after",
    with_(
        "cb",
        body=f"""SELECT id, CASE WHEN coalesce(state = 'open' AND next_attempt_at > {A}, false)
  THEN greatest(0, CAST(epoch(next_attempt_at) - epoch({A}) AS BIGINT)) END AS retry_after FROM cb""",
    ),
)
def breaker_retry_after(spark, sf):
    cb = T.breakers(spark, sf)
    return cb.select("id", CL.retry_after(F.col("state"), F.col("next_attempt_at"), T.ts(AS_OF)).alias("retry_after"))


@query(
    "breaker_progress",
    with_(
        "cb",
        body="SELECT id, CAST(least(round(failure_count * 100.0 / failure_threshold, 2), 100.0) AS DOUBLE) AS progress FROM cb",
    ),
)
def breaker_progress(spark, sf):
    cb = T.breakers(spark, sf)
    return cb.select("id", CL.breaker_progress(F.col("failure_count"), F.col("failure_threshold")).alias("progress"))


@query(
    "should_trip",
    with_(
        "err",
        body="""SELECT id, coalesce(error_code IN ('DATABASE_CONNECTION_FAILED', 'EXTERNAL_SERVICE_UNAVAILABLE', 'TIMEOUT_ERROR'), false)
  OR status_code >= 500 AS should_trip FROM err""",
    ),
)
def should_trip(spark, sf):
    e = _err(spark, sf)
    return e.select("id", CL.should_trip(F.col("error_code"), F.col("status_code")).alias("should_trip"))


@query(
    "normalised_status",
    """SELECT event_id AS id, CAST(floor(value * 10) AS BIGINT) % 700 AS raw_code,
  CASE WHEN CAST(floor(value * 10) AS BIGINT) % 700 BETWEEN 400 AND 599 THEN CAST(floor(value * 10) AS BIGINT) % 700 ELSE 500 END AS status
FROM events""",
)
def normalised_status(spark, sf):
    e = T.read(spark, sf, "events")
    raw = F.floor(F.col("value") * 10) % 700
    return e.select(F.col("event_id").alias("id"), raw.alias("raw_code"), CL.normalised_status(raw).alias("status"))


ACCESS_SQL = """acc AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'api/' || regexp_replace(request_url, '^https?://[^/]+/', '')
    ELSE regexp_replace(request_url, '^https?://[^/]+/', '') END AS path,
  list_extract(['application/json', 'application/problem+json', 'application/vnd.api+json', 'text/html'], CAST(id % 4 + 1 AS INT)) AS accept
  FROM err)"""


@query(
    "accept_format",
    with_(
        "err",
        body=f""", {ACCESS_SQL}
SELECT id, accept, CASE WHEN contains(accept, 'application/problem+json') THEN 'rfc7807'
  WHEN contains(accept, 'application/vnd.api+json') THEN 'jsonapi' ELSE 'jsend' END AS format FROM acc""",
    ),
)
def accept_format(spark, sf):
    a = T.access_log(spark, sf)
    return a.select("id", "accept", CL.accept_format(F.col("accept")).alias("format"))


@query(
    "api_requests",
    with_("err", body=f", {ACCESS_SQL} SELECT id, path, accept FROM acc WHERE contains(accept, 'json') OR starts_with(path, 'api/')"),
)
def api_requests(spark, sf):
    a = T.access_log(spark, sf)
    return a.filter(CL.is_api_request(F.col("accept"), F.col("path")))


TRACE_SQL = with_(
    "err",
    body=""", f AS (SELECT id, unnest(range(1, LEAST(occurrence_count + 4, 10) + 1)) AS i FROM err)
SELECT id, CAST(i AS INTEGER) AS pos,
  CASE WHEN i % 5 <> 0 THEN '/app/src/frame_' || CAST(i AS VARCHAR) ELSE 'unknown' END AS file,
  CASE WHEN i % 7 <> 0 THEN CAST(id % 100 + i AS INTEGER) ELSE 0 END AS line,
  'call' || CAST(i AS VARCHAR) AS function,
  CASE WHEN i % 2 = 0 THEN 'App\\Service' END AS class,
  CASE WHEN i % 4 = 0 THEN '::' WHEN i % 2 = 0 THEN '->' END AS type,
  ['password=***REDACTED***', 'plain'] AS args
FROM f""",
)


@query("trace_head", TRACE_SQL)
def trace_head(spark, sf):
    """The first 10 frames of each stored trace, one row per frame."""
    t = T.traces(spark, sf)
    x = t.select("id", F.posexplode(RN.trace_head(F.col("trace"))).alias("p", "frame"))
    return x.select("id", (F.col("p") + 1).alias("pos"), "frame.file", "frame.line", "frame.function", "frame.class", "frame.type", "frame.args")


@query(
    "status_share_bars",
    with_(
        "err",
        body=f""", d AS (SELECT status_code, count(*) AS count,
  CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS DOUBLE) AS percentage FROM err WHERE created_at >= {A} - INTERVAL 7 DAY GROUP BY 1)
SELECT status_code, count, percentage, CAST(round(percentage / 100.0 * 30) AS INT) AS filled,
  repeat('█', CAST(round(percentage / 100.0 * 30) AS INT)) || repeat('░', 30 - CAST(round(percentage / 100.0 * 30) AS INT)) AS bar FROM d""",
    ),
)
def status_share_bars(spark, sf):
    from faultline.operators import aggregates as AG
    from faultline.operators import trends as TR

    return TR.share_bars(AG.status_distribution(_err(spark, sf), AS_OF, 7), 30)
