"""Registered renderers (V1-V4, V7) with DuckDB twins built from json_object."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import config as C
from faultline.operators import render as RN
from faultline.plans.oracle import ERR
from faultline.plans.q_functions import VALCODE_SQL, category_sql, derived_sql, title_sql
from faultline.plans.q_redact import EMAIL_STEP, IP_STEP, PHONE_STEP, SECRET_STEPS
from faultline.plans.registry import query
from faultline.sources import tables as T


def _unesc(step: str) -> str:
    return step.replace("{{", "{").replace("}}", "}")


def _secrets(expr: str) -> str:
    out = expr
    for s in SECRET_STEPS:
        out = _unesc(s).replace("{t}", out)
    return out


def _stage(prev: str, cols, fn) -> str:
    repl = ", ".join(f"{fn(c)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM {prev}"


def _chain(cols_and_steps: list, first: str = "f0") -> tuple[list[str], str]:
    """CTEs that apply the steps one after another, and the name of the last."""
    ctes, prev = [], first
    for i, (cols, fn) in enumerate(cols_and_steps, start=1):
        name = f"{first}_{i}"
        ctes.append(f"{name} AS ({_stage(prev, cols, fn)})")
        prev = name
    return ctes, prev


def _pii(cols) -> list:
    return [(cols, lambda c, st=st: _unesc(st).replace("{t}", c)) for st in (IP_STEP, EMAIL_STEP, PHONE_STEP)]


# ---- JSON members in SQL: lists of {k, v} with v as JSON text -----------------------


def members(*pairs: tuple[str, str]) -> str:
    rows = ", ".join(f"{{'k': '{k}', 'v': CAST({v} AS VARCHAR)}}" for k, v in pairs)
    return f"list_filter([{rows}], lambda x: x.v IS NOT NULL)"


def put(base: str, over: str) -> str:
    keys = f"list_transform({over}, lambda z: z.k)"
    return (
        f"list_concat(list_transform({base}, lambda x: CASE WHEN list_contains({keys}, x.k) THEN {over}[list_position({keys}, x.k)] ELSE x END),"
        f" list_filter({over}, lambda y: NOT list_contains(list_transform({base}, lambda z: z.k), y.k)))"
    )


def obj(rows: str, x: str = "x") -> str:
    return f"('{{' || array_to_string(list_transform({rows}, lambda {x}: CAST(to_json({x}.k) AS VARCHAR) || ':' || {x}.v), ',') || '}}')"


def text(expr: str) -> str:
    return f"CAST(to_json({expr}) AS VARCHAR)"


STARS = "repeat('*', least(length(CAST(uid AS VARCHAR)), 5))"
#: What the metadata of the fixture is after masking and redaction, shape by shape.
META = f"""CASE id % 8
  WHEN 1 THEN '{{"user_id":' || uid || ',"api_token":"{C.MASK_STRING}","nested":{{"password":"{C.MASK_STRING}","deep":[{{"ssn":"{C.MASK_STRING}","ok":[1,2.5,"u' || {STARS} || '@example.com"]}}]}}}}'
  WHEN 2 THEN '{{"line":"' || k || '","column":' || (id % 80) || ',"path":["user",0,"email"],"customField":"custom value","count":42}}'
  WHEN 3 THEN '{{"locations":[{{"line":' || k || ',"column":2}}],"code":"META_CODE","category":"meta","type":"meta-type","title":"Meta title","status":418,"detail":"password={C.MASK_STRING}"}}'
  WHEN 4 THEN '{{"timestamp":"meta time","error_id":"meta id","suggestion":"meta suggestion","instance":"meta instance","help":false,"documentation":null}}'
  WHEN 6 THEN '{{"note":"from 192.*.*.* \\"quoted\\" \\\\ é","Secret-Key":"{C.MASK_STRING}","path":"no list","locations":"none","line":7}}'
  ELSE '{{}}' END"""
#: The members of the (masked) metadata, in order.
META_MEMBERS = "list_transform(json_keys(CAST(meta AS JSON)), lambda n: {'k': n, 'v': CAST(json_extract(CAST(meta AS JSON), '$.\"' || n || '\"') AS VARCHAR)})"

VALIDATION = f"""MAP {{
    list_extract({list(T.VALIDATION_FIELDS_A)}, k % 4 + 1):
      [list_extract({list(T.VALIDATION_MESSAGES_A)}, k % 5 + 1), list_extract({list(T.VALIDATION_MESSAGES_B)}, k % 3 + 1)],
    list_extract({list(T.VALIDATION_FIELDS_B)}, CAST(uid % 4 + 1 AS INT)):
      [list_extract({list(T.VALIDATION_MESSAGES_A)}, (k + 2) % 5 + 1)] }}"""


def _fields_sql() -> str:
    base = f"""rows AS (SELECT err.*, e.user_id AS uid, CAST(json_extract(e.props, '$.k') AS INT) AS k FROM err JOIN events e ON e.event_id = err.id),
f0 AS (SELECT id, k, uid, created_at, error_id, exception_class = '{C.VALIDATION_EXCEPTION}' AS invalid,
  CASE WHEN exception_class = '{C.VALIDATION_EXCEPTION}' THEN 422 WHEN status_code BETWEEN 400 AND 599 THEN status_code ELSE 500 END AS http_status, exception_class,
  CASE WHEN id % 7 = 0 THEN message || ' for u' || uid || '@example.com password=pw' || k WHEN id % 11 = 0 THEN '{C.GENERIC_MESSAGE}' ELSE message END AS msg,
  CASE WHEN exception_class = '{C.VALIDATION_EXCEPTION}' THEN 'VALIDATION_ERROR' ELSE coalesce(error_code, {derived_sql('exception_class')}) END AS code,
  CASE WHEN exception_class = '{C.VALIDATION_EXCEPTION}' THEN NULL WHEN k % 4 = 1 THEN 'Ask u' || uid || '@example.com, then retry' WHEN k % 4 = 2 THEN 'Retry later' END AS sugg,
  CASE WHEN exception_class <> '{C.VALIDATION_EXCEPTION}' AND k % 3 = 0 THEN 'https://docs.example.test/errors/' || k END AS link,
  CASE WHEN id % 10 > 0 THEN {VALIDATION} ELSE MAP([]::VARCHAR[], []::VARCHAR[][]) END AS validation,
  CASE WHEN exception_class = '{C.VALIDATION_EXCEPTION}' THEN '{{}}' ELSE {META} END AS meta FROM rows)"""
    ctes, last = _chain([*_pii(("msg", "sugg")), (("msg", "sugg"), _secrets)])
    end = f"""f AS (SELECT *, {category_sql('http_status', 'exception_class')} AS category, {META_MEMBERS} AS m,
  {text('error_id')} AS eid, {text("strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'")} AS ts,
  {text('msg')} AS j_msg, {text('code')} AS j_code, CASE WHEN sugg IS NOT NULL THEN {text('sugg')} END AS j_sugg,
  CASE WHEN link IS NOT NULL THEN {text('link')} END AS j_link,
  list_transform(map_entries(validation), lambda v: {{'k': v.key, 'v': v.value}}) AS fields FROM {last})"""
    return "WITH " + ",\n".join([ERR, base, *ctes, end])


JSEND_STATUS = "CASE WHEN http_status >= 500 THEN '\"error\"' WHEN http_status >= 400 THEN '\"fail\"' ELSE '\"success\"' END"
#: field -> {message, code}; without fields an empty list
_ONE_FIELD = obj(members(("message", text("v.v[1]")), ("code", text(VALCODE_SQL.format(m="v.v[1]")))), "y")
FIELD_ERRORS = f"CASE WHEN len(fields) = 0 THEN '[]' ELSE {obj(f"list_transform(fields, lambda v: {{'k': v.k, 'v': {_ONE_FIELD}}})")} END"


def listed(item: str) -> str:
    """The list of ``item`` (over v.k = field and msg1 = message) for all messages."""
    return f"('[' || array_to_string(flatten(list_transform(fields, lambda v: list_transform(v.v, lambda msg1: {item}))), ',') || ']')"


JSEND_SQL = (
    _fields_sql()
    + f""",
d AS (SELECT *, {members(("error_id", "eid"), ("timestamp", "ts"), ("suggestion", "j_sugg"), ("documentation", "j_link"))} AS own FROM f),
e AS (SELECT *, {put('m', 'own')} AS data FROM d)
SELECT id, http_status, CASE WHEN invalid THEN '{{"status":' || {JSEND_STATUS} || ',"data":' || {FIELD_ERRORS} || ',"message":' || j_msg || '}}'
  ELSE '{{"status":' || {JSEND_STATUS} || ',"message":' || j_msg || ',"code":' || j_code || ',"data":' || {obj('data')} || '}}' END AS body FROM e"""
)

PROBLEM_SQL = (
    _fields_sql()
    + f""",
d AS (SELECT *, {members(
        ("type", text("'https://api.example.com/errors/' || lower(replace(code, '_', '-'))")),
        ("title", text("CASE WHEN invalid THEN 'Validation Failed' ELSE " + title_sql("http_status") + " END")),
        ("status", "http_status"), ("detail", "j_msg"), ("instance", "eid"), ("errors", "CASE WHEN invalid THEN " + FIELD_ERRORS + " END"))} AS base,
  {members(("suggestion", "j_sugg"), ("help", "j_link"))} AS own FROM f),
e AS (SELECT *, {put('base', 'm')} AS mid FROM d),
g AS (SELECT *, {put('mid', 'own')} AS whole FROM e)
SELECT id, http_status, {obj('whole')} AS body FROM g"""
)

_ITEM = (
    "'{\"status\":\"422\",\"code\":' || " + text(VALCODE_SQL.format(m="msg1")) + " || ',\"title\":\"Validation Error\",\"detail\":' || " + text("msg1")
    + " || ',\"source\":{\"pointer\":' || " + text("'/data/attributes/' || replace(v.k, '.', '/')") + " || '}}'"
)
JSONAPI_SQL = (
    _fields_sql()
    + f""",
d AS (SELECT *, {members(("timestamp", "ts"), ("suggestion", "j_sugg"))} AS own FROM f),
e AS (SELECT *, {put('m', 'own')} AS meta_members FROM d)
SELECT id, http_status, '{{"errors":' || CASE WHEN invalid THEN {listed(_ITEM)} ELSE '[{{"status":"' || http_status || '","code":' || j_code
  || ',"title":"' || {title_sql('http_status')} || '","detail":' || j_msg || ',"id":' || eid || ',"meta":' || {obj('meta_members')}
  || CASE WHEN j_link IS NULL THEN '' ELSE ',"links":{{"about":' || j_link || '}}' END || '}}]' END || '}}' AS body FROM e"""
)

_GRAPHQL_ITEM = (
    "'{\"message\":' || " + text("msg1") + " || ',\"extensions\":{\"code\":' || j_code || ',\"category\":\"validation\",\"timestamp\":' || ts || ',\"errorId\":' || eid"
    " || ',\"field\":' || " + text("v.k") + " || ',\"validation\":true}}'"
)
GRAPHQL_SQL = (
    _fields_sql()
    + f""",
d AS (SELECT *, {members(("code", "j_code"), ("category", text("category")), ("timestamp", "ts"), ("errorId", "eid"))} AS base,
  list_filter(m, lambda x: x.k NOT IN ('locations', 'line', 'column', 'path')) AS rest,
  {members(("suggestion", "j_sugg"), ("documentation", "j_link"))} AS own,
  CASE id % 8 WHEN 2 THEN '"locations":[{{"line":' || k || ',"column":' || (id % 80) || '}}],"path":["user",0,"email"],'
    WHEN 3 THEN '"locations":[{{"line":' || k || ',"column":2}}],' ELSE '' END AS lifted FROM f),
e AS (SELECT *, {put('base', 'rest')} AS mid FROM d),
g AS (SELECT *, {put('mid', 'own')} AS ext FROM e)
SELECT id, http_status, '{{"errors":' || CASE WHEN invalid THEN {listed(_GRAPHQL_ITEM)} ELSE '[{{"message":' || j_msg || ',' || lifted
  || '"extensions":' || {obj('ext')} || '}}]' END || ',"data":null}}' AS body FROM g"""
)

RECORD_SQL = f"""WITH {ERR},
rows AS (SELECT err.*, e.user_id AS uid, CAST(json_extract(e.props, '$.k') AS INT) AS k FROM err JOIN events e ON e.event_id = err.id)
SELECT id, error_id, exception_class, error_code,
  CASE WHEN id % 7 = 0 THEN message || ' for u' || uid || '@example.com password=pw' || k WHEN id % 11 = 0 THEN '' ELSE message END AS message,
  CASE WHEN status_code BETWEEN 400 AND 599 THEN status_code ELSE 500 END AS status_code,
  CASE WHEN id % 3 = 0 THEN '{{"file":"/app/src/file_' || k || '.php","line":"' || id || '","trace":[],"tenant":{{"id":' || uid || '}}}}'
    ELSE '{{"file":"/app/src/file_' || k || '.php","line":' || k || ',"trace":[]}}' END AS context,
  CASE WHEN id % 4 > 0 THEN raw WHEN raw = '{{}}' THEN '{{"suggestions":["Retry","Ask support"]}}'
    ELSE left(raw, length(raw) - 1) || ',"suggestions":["Retry","Ask support"]}}' END AS meta
FROM (SELECT *, CASE id % 8
  WHEN 1 THEN '{{"user_id":' || uid || ',"api_token":"tok-' || id || '","nested":{{"password":"pw' || k || '","deep":[{{"ssn":' || k || ',"ok":[1,2.5,"u' || uid || '@example.com"]}}]}}}}'
  WHEN 2 THEN '{{"line":"' || k || '","column":' || (id % 80) || ',"path":["user",0,"email"],"customField":"custom value","count":42}}'
  WHEN 3 THEN '{{"locations":[{{"line":' || k || ',"column":2}}],"code":"META_CODE","category":"meta","type":"meta-type","title":"Meta title","status":418,"detail":"password=pw' || k || '"}}'
  WHEN 4 THEN '{{"timestamp":"meta time","error_id":"meta id","suggestion":"meta suggestion","instance":"meta instance","help":false,"documentation":null}}'
  WHEN 6 THEN '{{"note":"from 192.168.1.' || (k % 100) || ' \\"quoted\\" \\\\ é","Secret-Key":null,"path":"no list","locations":"none","line":7}}'
  ELSE '{{}}' END AS raw FROM rows)"""


@query("assemble_error_records", RECORD_SQL)
def assemble_error_records(spark, sf):
    """The stored record of every error, one column per field."""
    return RN.assemble_error_records(T.error_responses(spark, sf))


def _err(spark, sf):
    return T.error_responses(spark, sf)


@query("render_jsend", JSEND_SQL)
def render_jsend(spark, sf):
    return RN.render(_err(spark, sf), "jsend")


@query("render_problem", PROBLEM_SQL)
def render_problem(spark, sf):
    return RN.render(_err(spark, sf), "rfc7807")


@query("render_jsonapi", JSONAPI_SQL)
def render_jsonapi(spark, sf):
    return RN.render(_err(spark, sf), "jsonapi")


@query("render_graphql", GRAPHQL_SQL)
def render_graphql(spark, sf):
    return RN.render(_err(spark, sf), "graphql")


PUBLIC_SQL = (
    "WITH "
    + ERR
    + f""",
p0 AS (SELECT id, coalesce(nullif(message, ''), '{C.GENERIC_MESSAGE}') AS msg FROM err),
p1 AS ({_stage('p0', ('msg',), lambda c: _unesc(IP_STEP).replace('{t}', c))}),
p2 AS ({_stage('p1', ('msg',), lambda c: _unesc(EMAIL_STEP).replace('{t}', c))})
{_stage('p2', ('msg',), lambda c: _unesc(PHONE_STEP).replace('{t}', c))}"""
)


@query("public_message", PUBLIC_SQL)
def public_message(spark, sf):
    e = T.errors(spark, sf)
    return e.select("id", RN.public_message(F.col("message")).alias("msg"))
