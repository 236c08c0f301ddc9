"""Registered redaction / masking queries (F1-F13) with DuckDB twins.

The DuckDB twin of replace-with-callback is ``string_split_regex`` +
``regexp_extract_all`` + ``list_transform(list_zip(...))``; RE2 has no
look-around, so the oracle keeps the original ``\\b`` word boundaries.
Chained passes are staged as CTEs so each pass reads the previous one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import config as C

from faultline.functions import jsontext as J
from faultline.functions import nested as N
from faultline.functions import redact as RD
from faultline.plans.registry import query
from faultline.sources import tables as T

# RE2 keeps the configured patterns as they are (``\b`` included)
IP_SQL = C.PII_IP_PATTERN
EMAIL_SQL = C.PII_EMAIL_PATTERN
PHONE_SQL = C.PII_PHONE_PATTERN

F_IP = (
    "CASE WHEN list_bool_and(list_transform(string_split({m}, '.'), lambda o: regexp_full_match(o, '0|[1-9][0-9]{{0,2}}')"
    " AND TRY_CAST(o AS INT) <= 255)) THEN split_part({m}, '.', 1) || '.*.*.*' ELSE {m} END"
)
F_EMAIL = (
    "CASE WHEN length(split_part({m}, '@', 1)) <= 64 AND NOT starts_with(split_part({m}, '@', 1), '.')"
    " AND NOT ends_with(split_part({m}, '@', 1), '.') AND NOT contains(split_part({m}, '@', 1), '..')"
    " AND NOT starts_with(split_part({m}, '@', 2), '.') AND NOT contains(split_part({m}, '@', 2), '..')"
    " AND NOT regexp_matches(split_part({m}, '@', 2), '(^|\\.)-|-($|\\.)') AND length(split_part({m}, '@', 2)) <= 253"
    " THEN left(split_part({m}, '@', 1), 1) || repeat('*', least(length(split_part({m}, '@', 1)) - 1, 5)) || '@' || split_part({m}, '@', 2)"
    " ELSE {m} END"
)
F_PHONE = (
    "CASE WHEN length(regexp_replace({m}, '\\D', '', 'g')) < 4 THEN repeat('*', length(regexp_replace({m}, '\\D', '', 'g')))"
    " ELSE repeat('*', length(regexp_replace({m}, '\\D', '', 'g')) - 4) || right(regexp_replace({m}, '\\D', '', 'g'), 4) END"
)


def duck_cb(t: str, pattern: str, f: str) -> str:
    parts = f"string_split_regex({t}, '{pattern}')"
    ms = f"regexp_extract_all({t}, '{pattern}')"
    body = f.format(m="z[1]")
    return (
        f"CASE WHEN regexp_matches({t}, '{pattern}') THEN {parts}[1] || array_to_string(list_transform("
        f"list_zip({ms}, {parts}[2:]), lambda z: ({body}) || z[2]), '') ELSE {t} END"
    )


DOCS = "docs AS (SELECT doc_id, text FROM documents)"


def staged(src: str, key: str, steps: list[str], out: str = "text") -> str:
    """``WITH s0 AS src, s1 AS (step over s0.t) ...`` returning (key, out)."""
    ctes = [src]
    prev = src.split(" AS ", 1)[0]
    col = "text"
    for i, step in enumerate(steps):
        name = f"s{i + 1}"
        ctes.append(f"{name} AS (SELECT {key}, {step.format(t=col)} AS t{i + 1} FROM {prev})")
        prev, col = name, f"t{i + 1}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {key}, {col} AS {out} FROM {prev}"


def _step(pattern: str, f: str) -> str:
    # build a step template with {t} as the only placeholder
    return duck_cb("__T__", pattern, f).replace("{", "{{").replace("}", "}}").replace("__T__", "{t}")


IP_STEP = _step(IP_SQL, F_IP)
EMAIL_STEP = _step(EMAIL_SQL, F_EMAIL)
PHONE_STEP = _step(PHONE_SQL, F_PHONE)

LINES = f"""lines AS (SELECT event_id AS id, concat('Contact user', CAST(user_id AS VARCHAR), ' at +', CAST(user_id % 9 + 1 AS VARCHAR),
  lpad(CAST(event_id * 7919 % 1000000000 AS VARCHAR), 9, '0'), ' or u', CAST(user_id AS VARCHAR), '@example.com from ',
  CAST(k + 150 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR), '.1.', CAST(event_id % 300 AS VARCHAR),
  ' password=', CAST(user_id AS VARCHAR), ' token=abc', CAST(k AS VARCHAR), '&api_key=key', CAST(event_id AS VARCHAR),
  ' Authorization: Bearer tok.', CAST(k AS VARCHAR), ' card 4111-1111-1111-', lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')) AS text
  FROM (SELECT e.*, CAST(json_extract(props, '$.k') AS INT) AS k FROM events e) x)"""


@query("redact_documents", staged(DOCS, "doc_id", [IP_STEP, EMAIL_STEP, PHONE_STEP]))
def redact_documents(spark, sf):
    d = T.documents(spark, sf)
    return d.select("doc_id", RD.redact(F.col("text")).alias("text"))


@query("mask_ips", staged(DOCS, "doc_id", [IP_STEP]))
def mask_ips(spark, sf):
    return T.documents(spark, sf).select("doc_id", RD.mask_ips(F.col("text")).alias("text"))


@query("mask_emails", staged(DOCS, "doc_id", [EMAIL_STEP]))
def mask_emails(spark, sf):
    return T.documents(spark, sf).select("doc_id", RD.mask_emails(F.col("text")).alias("text"))


@query("mask_phones", staged(LINES, "id", [PHONE_STEP]))
def mask_phones(spark, sf):
    return T.contact_lines(spark, sf).select("id", RD.mask_phones(F.col("text")).alias("text"))


@query("redact_contact_lines", staged(LINES, "id", [IP_STEP, EMAIL_STEP, PHONE_STEP]))
def redact_contact_lines(spark, sf):
    return T.contact_lines(spark, sf).select("id", RD.redact(F.col("text")).alias("text"))


TAG_STEPS = [
    "regexp_replace({t}, '" + EMAIL_SQL + "', '[email:REDACTED]', 'g')",
    "regexp_replace({t}, '" + r"\+?[1-9]\d{{1,14}}" + "', '[phone:REDACTED]', 'g')",
    "regexp_replace({t}, '" + IP_SQL.replace("{", "{{").replace("}", "}}") + "', '[ip:REDACTED]', 'g')",
]
TAG_STEPS[0] = TAG_STEPS[0].replace("{2,}", "{{2,}}")


@query("tag_redact_documents", staged(DOCS, "doc_id", TAG_STEPS))
def tag_redact_documents(spark, sf):
    return T.documents(spark, sf).select("doc_id", RD.tag_redact(F.col("text")).alias("text"))


def _esc(p: str) -> str:
    return p.replace("{", "{{").replace("}", "}}")


def _replace_step(pattern: str, repl: str) -> str:
    """A DuckDB regexp_replace step template (``{t}`` is the input)."""
    return "regexp_replace({t}, '" + _esc(pattern) + "', '" + _esc(repl.replace("$1", "\\1")) + "', 'g')"


SECRET_STEPS = [_replace_step(p, r) for p, r in C.SECRET_PATTERNS]


@query("mask_secrets_documents", staged(DOCS, "doc_id", SECRET_STEPS))
def mask_secrets_documents(spark, sf):
    return T.documents(spark, sf).select("doc_id", RD.mask_secrets(F.col("text")).alias("text"))


@query("mask_secrets_lines", staged(LINES, "id", SECRET_STEPS))
def mask_secrets_lines(spark, sf):
    return T.contact_lines(spark, sf).select("id", RD.mask_secrets(F.col("text")).alias("text"))


SQLTXT = """sqls AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0
  THEN concat('SELECT * FROM `', event_type, '` WHERE `email` = "u', CAST(user_id AS VARCHAR), '@example.com"')
  ELSE concat('SELECT id FROM ', event_type, ' JOIN users ON users.id = ', event_type, '.user_id WHERE name = "x', CAST(user_id AS VARCHAR), '"') END AS text
  FROM events)"""
SQL_STEPS = [_replace_step(p, r) for p, r in C.SQL_SANITIZE_PATTERNS]


@query("sanitize_sql", staged(SQLTXT, "id", SQL_STEPS, out="sql"))
def sanitize_sql(spark, sf):
    return T.sql_texts(spark, sf).select("id", RD.sanitize_sql(F.col("sql")).alias("sql"))


# ---- nested payloads -----------------------------------------------------------

def _payload_type(df):
    return df.schema["payload"].dataType


def _flatten(col):
    return [
        col.getField("user").getField("name").alias("user_name"),
        col.getField("user").getField("password").alias("user_password"),
        col.getField("user").getField("email").alias("user_email"),
        col.getField("user").getField("age").alias("user_age"),
        col.getField("api_key").alias("api_key"),
        col.getField("access_token").alias("access_token"),
        col.getField("tags").alias("tags"),
        col.getField("note").alias("note"),
        col.getField("attempts").alias("attempts"),
    ]


PAYLOAD_SRC = """p AS (SELECT event_id AS id, concat('user', CAST(user_id AS VARCHAR)) AS user_name,
  concat('pw', CAST(k AS VARCHAR)) AS user_password, concat('u', CAST(user_id AS VARCHAR), '@example.com') AS user_email,
  CAST(k % 80 + 18 AS INT) AS user_age, concat('key_', CAST(event_id AS VARCHAR)) AS api_key,
  concat('tok_', CAST(k AS VARCHAR)) AS access_token,
  [event_type, concat('from 10.0.', CAST(k % 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR))] AS tags,
  concat('password=', CAST(user_id AS VARCHAR), ' call +1234567', lpad(CAST(user_id AS VARCHAR), 4, '0')) AS note,
  CAST(k % 4 AS INT) AS attempts
  FROM (SELECT e.*, CAST(json_extract(props, '$.k') AS INT) AS k FROM events e) x)"""


def _secrets_sql(expr: str) -> str:
    out = expr
    for step in SECRET_STEPS:
        out = step.replace("{{", "{").replace("}}", "}").replace("{t}", out)
    return out


M = "'***REDACTED***'"

MASK_JSON_SQL = (
    "WITH "
    + PAYLOAD_SRC
    + f"""
SELECT id, {_secrets_sql('user_name')} AS user_name, {M} AS user_password, {_secrets_sql('user_email')} AS user_email,
  user_age, {M} AS api_key, {M} AS access_token,
  list_transform(tags, lambda s: {_secrets_sql('s')}) AS tags, {_secrets_sql('note')} AS note, attempts FROM p"""
)


@query("mask_json_props", MASK_JSON_SQL)
def mask_json_props(spark, sf):
    p = T.nested_payloads(spark, sf)
    masked = N.mask_nested(F.col("payload"), _payload_type(p))
    return p.select("id", *_flatten(masked))


def _apply(step: str, expr: str) -> str:
    return step.replace("{{", "{").replace("}}", "}").replace("{t}", expr)


def _redact_stage(prev: str, step: str) -> str:
    strs = ("user_name", "user_password", "user_email", "api_key", "access_token", "note")
    cols = ", ".join(f"{_apply(step, c)} AS {c}" for c in strs)
    return f"SELECT id, {cols}, user_age, list_transform(tags, lambda s: {_apply(step, 's')}) AS tags, attempts FROM {prev}"


SECURE_SQL = (
    "WITH "
    + PAYLOAD_SRC
    + f""",
m AS (SELECT id, {_secrets_sql('user_name')} AS user_name, {M} AS user_password, {_secrets_sql('user_email')} AS user_email,
  user_age, {M} AS api_key, {M} AS access_token,
  list_transform(tags, lambda s: {_secrets_sql('s')}) AS tags, {_secrets_sql('note')} AS note, attempts FROM m0),
r1 AS ({_redact_stage('m', IP_STEP)}),
r2 AS ({_redact_stage('r1', EMAIL_STEP)})
{_redact_stage('r2', PHONE_STEP)}"""
).replace("FROM m0)", "FROM p)")


@query("secure_pipeline", SECURE_SQL)
def secure_pipeline(spark, sf):
    p = T.nested_payloads(spark, sf)
    out = N.secure_pipeline(F.col("payload"), _payload_type(p))
    return p.select("id", *_flatten(out))


REQ_SQL = (
    "WITH "
    + PAYLOAD_SRC
    + """
SELECT id, user_name, '[REDACTED]' AS user_password, user_email, user_age, '[REDACTED]' AS api_key,
  '[REDACTED]' AS access_token, tags, note, attempts FROM p"""
)


@query("sanitize_request_data", REQ_SQL)
def sanitize_request_data(spark, sf):
    p = T.nested_payloads(spark, sf)
    out = N.sanitize_request_data(F.col("payload"), _payload_type(p))
    return p.select("id", *_flatten(out))


REDACT_NESTED_SQL = (
    "WITH "
    + PAYLOAD_SRC
    + f""",
r1 AS ({_redact_stage('p', IP_STEP)}),
r2 AS ({_redact_stage('r1', EMAIL_STEP)}),
r3 AS ({_redact_stage('r2', PHONE_STEP)})
SELECT id, user_name, user_password, user_email, user_age, api_key, access_token, tags, note, attempts FROM r3"""
)

SANITIZE_CTX_SQL = (
    "WITH "
    + PAYLOAD_SRC
    + f""",
s AS (SELECT id, user_name, {M} AS user_password, user_email, user_age, {M} AS api_key, {M} AS access_token, tags, note, attempts FROM p)
SELECT id, user_name, user_password, user_email, user_age, api_key, access_token, tags, note, attempts FROM s"""
)

HEADERS_SQL = """SELECT event_id AS id, MAP {'Authorization': '[REDACTED]',
  'Accept': list_extract(['application/json', 'application/problem+json', 'application/vnd.api+json', 'text/html'], CAST(event_id % 4 + 1 AS INT)),
  'X-Request-Id': 'req-' || CAST(event_id AS VARCHAR), 'Cookie': '[REDACTED]'} AS headers FROM events"""

META_MERGE_SQL = """SELECT event_id AS id, MAP {'request_id': 'req-' || CAST(event_id AS VARCHAR), 'source': 'worker',
  'accept': list_extract(['application/json', 'application/problem+json', 'application/vnd.api+json', 'text/html'], CAST(event_id % 4 + 1 AS INT))} AS meta
FROM events"""


@query("redact_nested", REDACT_NESTED_SQL)
def redact_nested(spark, sf):
    p = T.nested_payloads(spark, sf)
    return p.select("id", *_flatten(N.redact_nested(F.col("payload"), _payload_type(p))))


@query("sanitize_context", SANITIZE_CTX_SQL)
def sanitize_context(spark, sf):
    p = T.nested_payloads(spark, sf)
    return p.select("id", *_flatten(N.sanitize_context(F.col("payload"), _payload_type(p))))


@query("sanitize_headers", HEADERS_SQL)
def sanitize_headers(spark, sf):
    h = T.request_headers(spark, sf)
    return h.select("id", N.sanitize_headers(F.col("headers")).alias("headers"))


@query("meta_merge", META_MERGE_SQL)
def meta_merge(spark, sf):
    h = T.request_headers(spark, sf)
    base = F.create_map(F.lit("request_id"), F.concat(F.lit("req-"), F.col("id").cast("string")), F.lit("source"), F.lit("api"))
    extra = F.create_map(F.lit("source"), F.lit("worker"), F.lit("accept"), F.element_at(F.col("headers")["Accept"], 1))
    return h.select("id", N.merge_meta(base, extra).alias("meta"))


# ---- JSON text of unknown depth ---------------------------------------------------

JSON_ROWS = "rows AS (SELECT event_id AS id, user_id AS uid, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"


def _json_sql(token: str, password: str, ssn: str, mail: str, detail: str, ip: str, secret: str, plain: str) -> str:
    """The payloads shape by shape, with SQL for each of the places that a rule may rewrite."""
    return f"""WITH {JSON_ROWS} SELECT id, CASE id % 8
  WHEN 1 THEN '{{"user_id":' || uid || ',"api_token":"' || {token} || '","nested":{{"password":"' || {password} || '","deep":[{{"ssn":' || {ssn} || ',"ok":[1,2.5,"' || {mail} || '"]}}]}}}}'
  WHEN 2 THEN '{{"line":"' || k || '","column":' || (id % 80) || ',"path":["user",0,"email"],"customField":"custom value","count":42}}'
  WHEN 3 THEN '{{"locations":[{{"line":' || k || ',"column":2}}],"code":"META_CODE","category":"meta","type":"meta-type","title":"Meta title","status":418,"detail":"password=' || {detail} || '"}}'
  WHEN 4 THEN '{{"timestamp":"meta time","error_id":"meta id","suggestion":"meta suggestion","instance":"meta instance","help":false,"documentation":null}}'
  WHEN 5 THEN '{{}}'
  WHEN 6 THEN '{{"note":"from ' || {ip} || ' \\"quoted\\" \\\\ é","Secret-Key":' || {secret} || ',"path":"no list","locations":"none","line":7}}'
  WHEN 7 THEN {plain} END AS payload FROM rows"""


_MAIL, _STARRED = "'u' || uid || '@example.com'", "'u' || repeat('*', least(length(CAST(uid AS VARCHAR)), 5)) || '@example.com'"
_IP, _TOKEN, _PW = "'192.168.1.' || (k % 100)", "'tok-' || id", "'pw' || k"
_QUOTED = f"""'"{C.MASK_STRING}"'"""
JSON_SQL = {
    "stored_meta": _json_sql(_TOKEN, _PW, "k", _MAIL, _PW, _IP, "'null'", "NULL"),
    "mask_json_text": _json_sql(M, M, _QUOTED, _MAIL, M, _IP, _QUOTED, f"'token={C.MASK_STRING} of ' || {_MAIL}"),
    "redact_json_text": _json_sql(_TOKEN, _PW, "k", _STARRED, _PW, "'192.*.*.*'", "'null'", f"'token=tok' || k || ' of ' || {_STARRED}"),
    "secure_json_text": _json_sql(M, M, _QUOTED, _STARRED, M, "'192.*.*.*'", _QUOTED, f"'token={C.MASK_STRING} of ' || {_STARRED}"),
    "sanitize_json_context": _json_sql(M, M, "k", _MAIL, _PW, _IP, "'null'", f"'token=tok' || k || ' of ' || {_MAIL}"),
    "sanitize_request_json": _json_sql(_TOKEN, f"'{C.KEY_REDACTED}'", "k", _MAIL, _PW, _IP, "'null'", f"'token=tok' || k || ' of ' || {_MAIL}"),
}


def _json_query(name: str, fn) -> None:
    @query(name, JSON_SQL[name])
    def run(spark, sf):
        return T.json_payloads(spark, sf).select("id", fn(F.col("payload")).alias("payload"))


_json_query("mask_json_text", J.mask_json)
_json_query("redact_json_text", J.redact_json)
_json_query("secure_json_text", J.secure_json)
_json_query("sanitize_json_context", J.sanitize_json)
_json_query("sanitize_request_json", J.sanitize_request_json)
