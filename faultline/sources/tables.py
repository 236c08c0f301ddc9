"""Readers for the driver tables and the adapters that shape them into the
error-analytics model (errors, calls, breakers, attempts).

Every adapter is a narrow ``select`` over one parquet scan, so Catalyst
prunes the columns the caller does not use and pushes the caller's filters
into the parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed vocabularies the adapters map integer keys onto.
EXCEPTION_CLASSES = (
    "ValidationException",
    "AuthenticationException",
    "AuthorizationException",
    "NotFoundHttpException",
    "AccessDeniedHttpException",
    "Exception",
)
ERROR_CODES = ("VALIDATION_FAILED", "UNAUTHORIZED", "FORBIDDEN", "NOT_FOUND", "INTERNAL_ERROR", "RATE_LIMIT_EXCEEDED")
MESSAGES = (
    "Connection timeout",
    "Connection failed",
    "API rate_limit exceeded",
    "Authentication failed",
    "Validation failed",
    "Unknown error",
    "HTTP 503 error",
    "Network error",
)
STATUS_CODES = (400, 401, 403, 404, 422, 429, 500, 502, 503)
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
SERVICES = ("api-service", "database", "payment-gateway", "email-service", "storage-service")
OPERATIONS = ("create_user", "process_payment", "send_email", "upload_file", "fetch_data")
USER_AGENTS = ("Mozilla/5.0", "curl/8.5", "okhttp/4.12")
ATTEMPT_STATUS = (429, 500, 502, 503, 422)
ATTEMPT_MESSAGES = ("Connection timeout", "Invalid data", "Network error", "HTTP 503 error")

AS_OF = "2024-01-31 00:00:00"


def ts(value: str) -> Column:
    """A TIMESTAMP_NTZ literal (the driver tables hold zone-less timestamps)."""
    return F.lit(value).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The rows spread evenly over all cores, for work that costs far more than reading: a scan has one task for
    each large row group at most, however many cores there are."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def pick(values, index: Column) -> Column:
    """``values[index]`` for a 1-based integer column over a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _text(*parts) -> Column:
    """Literals and columns as one string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One error row per event; ``error_id`` repeats so roll-ups have work."""
    return errors_from_events(read(spark, sf_dir, "events"))


def errors_from_events(e: DataFrame, *keep: str) -> DataFrame:
    """The errors adapter over an events frame (batch or streaming); columns named in ``keep`` stay."""
    k = F.get_json_object("props", "$.k").cast("int")
    x = e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), *keep)
    kk = F.col("k")
    return x.select(
        *keep,
        F.col("event_id").alias("id"),
        F.concat(F.lit("err_"), "event_type", F.lit("_"), kk.cast("string")).alias("error_id"),
        pick(EXCEPTION_CLASSES, kk % 6 + 1).alias("exception_class"),
        F.when(kk % 10 >= 3, pick(ERROR_CODES, kk % 6 + 1)).alias("error_code"),
        F.concat(pick(MESSAGES, kk % 8 + 1), F.lit(" in "), "event_type").alias("message"),
        pick(STATUS_CODES, kk % 9 + 1).alias("status_code"),
        pick(METHODS, F.col("event_id") % 5 + 1).alias("request_method"),
        F.concat(F.lit("https://api.example.test/"), "event_type", F.lit("/"), (kk % 20).cast("string")).alias(
            "request_url"
        ),
        F.when(F.col("event_id") % 10 < 6, F.col("user_id").cast("string")).alias("user_id"),
        (kk % 5 == 0).alias("is_resolved"),
        (kk % 10 + 1).alias("occurrence_count"),
        F.col("value").alias("response_ms"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.when(kk % 5 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"),
        _text("10.", kk, ".", F.col("event_id") % 256, ".7").alias("ip_address"),
        pick(USER_AGENTS, kk % 3 + 1).alias("user_agent"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-outcome log keyed by (service, operation); operation may be null."""
    return calls_from_events(read(spark, sf_dir, "events"))


def calls_from_events(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        pick(SERVICES, k % 5 + 1).alias("service"),
        F.when(F.col("user_id") % 5 >= 2, pick(OPERATIONS, F.col("user_id") % 5 + 1)).alias("operation"),
        (F.col("event_type") != "error").alias("ok"),
        pick(MESSAGES, k % 8 + 1).alias("message"),
    )


def breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuit-breaker rows derived from ``supplier``."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    key, nat = F.col("s_suppkey"), F.col("s_nationkey")
    as_of = ts(AS_OF)
    failed_at = as_of - F.make_dt_interval(F.lit(0), F.lit(0), (key % 120).cast("int"))
    return s.select(
        key.alias("id"),
        pick(SERVICES, key % 5 + 1).alias("service"),
        F.when(key % 10 >= 4, F.concat(F.lit("op_"), key.cast("string"))).alias("operation"),
        pick(("closed", "open", "half_open"), nat % 3 + 1).alias("state"),
        F.when(nat % 3 == 0, F.lit(0)).otherwise((key % 10 + 1).cast("int")).alias("failure_count"),
        (nat % 5 + 3).alias("failure_threshold"),
        (key % 91 + 30).cast("int").alias("recovery_timeout"),
        (nat % 4 + 2).alias("success_threshold"),
        F.when(nat % 3 != 0, failed_at).alias("last_failure_at"),
        F.when(nat % 3 != 0, failed_at).alias("opened_at"),
        F.when(
            nat % 3 == 1,
            as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (key % 121 - 60).cast("int")),
        ).alias("next_attempt_at"),
        (as_of - F.make_dt_interval(F.lit(0), F.lit(0), key.cast("int"))).alias("updated_at"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry attempt log from ``lineitem``: one row per attempt of a call.

    Attempts are not numbered here: ordering within a call is the tuple
    ``(l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity,
    l_extendedprice)`` carried as ``ord`` so operators can take the first
    attempts without numbering the whole group.
    """
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("call_id"),
        F.struct(
            "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
        ).alias("ord"),
        (F.col("l_partkey") % 3 == 0).alias("ok"),
        pick(ATTEMPT_STATUS, F.col("l_suppkey") % 5 + 1).alias("status_code"),
        pick(ATTEMPT_MESSAGES, F.col("l_partkey") % 4 + 1).alias("message"),
        F.col("l_shipdate").alias("ts"),
    )


# ---- inputs for the text and nested-value functions -------------------------

ACCEPTS = ("application/json", "application/problem+json", "application/vnd.api+json", "text/html")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_k(read(spark, sf_dir, "events"))


def _with_k(e: DataFrame) -> DataFrame:
    return e.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


def contact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text lines with phones, e-mails, IPs and secrets, one per event."""
    x = _with_k(spread(read(spark, sf_dir, "events")))
    uid, k, eid = F.col("user_id"), F.col("k"), F.col("event_id")
    line = F.concat(
        F.lit("Contact user"), uid.cast("string"), F.lit(" at +"), (uid % 9 + 1).cast("string"),
        F.lpad((eid * 7919 % 1000000000).cast("string"), 9, "0"),
        F.lit(" or u"), uid.cast("string"), F.lit("@example.com from "),
        (k + 150).cast("string"), F.lit("."), (uid % 256).cast("string"), F.lit(".1."), (eid % 300).cast("string"),
        F.lit(" password="), uid.cast("string"), F.lit(" token=abc"), k.cast("string"),
        F.lit("&api_key=key"), eid.cast("string"), F.lit(" Authorization: Bearer tok."), k.cast("string"),
        F.lit(" card 4111-1111-1111-"), F.lpad((eid % 10000).cast("string"), 4, "0"),
    )
    return x.select(eid.alias("id"), line.alias("text"))


NESTED_TYPE = (
    "struct<user:struct<name:string,password:string,email:string,age:int>,api_key:string,"
    "access_token:string,tags:array<string>,note:string,attempts:int>"
)


def nested_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed nested payload per event (user object, secrets, tag list)."""
    x = _events_k(spark, sf_dir)
    uid, k, eid = F.col("user_id"), F.col("k"), F.col("event_id")
    payload = F.struct(
        F.struct(
            F.concat(F.lit("user"), uid.cast("string")).alias("name"),
            F.concat(F.lit("pw"), k.cast("string")).alias("password"),
            F.concat(F.lit("u"), uid.cast("string"), F.lit("@example.com")).alias("email"),
            (k % 80 + 18).cast("int").alias("age"),
        ).alias("user"),
        F.concat(F.lit("key_"), eid.cast("string")).alias("api_key"),
        F.concat(F.lit("tok_"), k.cast("string")).alias("access_token"),
        F.array(F.col("event_type"), F.concat(F.lit("from 10.0."), (k % 256).cast("string"), F.lit("."), (uid % 256).cast("string"))).alias("tags"),
        F.concat(F.lit("password="), uid.cast("string"), F.lit(" call +1234567"), F.lpad(uid.cast("string"), 4, "0")).alias("note"),
        (k % 4).cast("int").alias("attempts"),
    )
    return x.select(eid.alias("id"), payload.alias("payload"))


def request_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map<string, array<string>> request headers per event."""
    x = _events_k(spark, sf_dir)
    uid, k = F.col("user_id"), F.col("k")
    headers = F.create_map(
        F.lit("Authorization"), F.array(F.concat(F.lit("Bearer t"), k.cast("string"))),
        F.lit("Accept"), F.array(pick(ACCEPTS, F.col("event_id") % 4 + 1), F.lit("*/*")),
        F.lit("X-Request-Id"), F.array(F.concat(F.lit("req-"), F.col("event_id").cast("string"))),
        F.lit("Cookie"), F.array(F.concat(F.lit("session="), uid.cast("string"))),
    )
    return x.select(F.col("event_id").alias("id"), headers.alias("headers"))


def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query text per event: back-ticked and bare-name shapes."""
    x = _events_k(spark, sf_dir)
    uid, et = F.col("user_id").cast("string"), F.col("event_type")
    ticked = F.concat(F.lit("SELECT * FROM `"), et, F.lit("` WHERE `email` = \"u"), uid, F.lit("@example.com\""))
    bare = F.concat(F.lit("SELECT id FROM "), et, F.lit(" JOIN users ON users.id = "), et, F.lit(".user_id WHERE name = \"x"), uid, F.lit("\""))
    return x.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, ticked).otherwise(bare).alias("sql"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request path + Accept header per error row."""
    e = errors(spark, sf_dir).select("id", "request_url")
    path = F.regexp_replace(F.col("request_url"), r"^https?://[^/]+/", "")
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("api/"), path)).otherwise(path)
    return e.select("id", path.alias("path"), pick(ACCEPTS, F.col("id") % 4 + 1).alias("accept"))


VALIDATION_FIELDS_A = ("email", "age", "address.street", "profile.name")
VALIDATION_FIELDS_B = ("password", "user.phone", "name", "items.0.sku")
VALIDATION_MESSAGES_A = ("This field is required.", "Must be a valid email address.", "Must be numeric.", "Must be a string.", "Is invalid.")
VALIDATION_MESSAGES_B = ("Is too long.", "Must be a valid email address.", "Has already been taken.")


def _validation_map(k: Column, uid: Column) -> Column:
    return F.create_map(
        pick(VALIDATION_FIELDS_A, k % 4 + 1),
        F.array(pick(VALIDATION_MESSAGES_A, k % 5 + 1), pick(VALIDATION_MESSAGES_B, k % 3 + 1)),
        pick(VALIDATION_FIELDS_B, uid % 4 + 1),
        F.array(pick(VALIDATION_MESSAGES_A, (k + 2) % 5 + 1)),
    )


def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field -> messages maps for the 422 error rows."""
    x = _events_k(spark, sf_dir).filter(F.col("k") % 9 == 4)
    return x.select(F.col("event_id").alias("id"), _validation_map(F.col("k"), F.col("user_id")).alias("errors"))


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text of mixed types and depths, one per event (every eighth is null, some are no documents)."""
    x = _events_k(spark, sf_dir)
    return x.select(F.col("event_id").alias("id"), meta_text(F.col("event_id"), F.col("user_id"), F.col("k")).alias("payload"))


def meta_text(eid: Column, uid: Column, k: Column) -> Column:
    """Metadata of an error as JSON text: nested secrets, keys that collide with those of a body, GraphQL places, odd types."""
    shape = eid % 8
    return (
        F.when(shape == 1, _text('{"user_id":', uid, ',"api_token":"tok-', eid, '","nested":{"password":"pw', k,
                                 '","deep":[{"ssn":', k, ',"ok":[1,2.5,"u', uid, '@example.com"]}]}}'))
        .when(shape == 2, _text('{"line":"', k, '","column":', eid % 80, ',"path":["user",0,"email"],"customField":"custom value","count":42}'))
        .when(shape == 3, _text('{"locations":[{"line":', k, ',"column":2}],"code":"META_CODE","category":"meta","type":"meta-type",'
                                '"title":"Meta title","status":418,"detail":"password=pw', k, '"}'))
        .when(shape == 4, F.lit('{"timestamp":"meta time","error_id":"meta id","suggestion":"meta suggestion","instance":"meta instance",'
                                '"help":false,"documentation":null}'))
        .when(shape == 5, F.lit("{}"))
        .when(shape == 6, _text('{"note":"from 192.168.1.', k % 100, ' \\"quoted\\" \\\\ é","Secret-Key":null,"path":"no list","locations":"none","line":7}'))
        .when(shape == 7, _text("token=tok", k, " of u", uid, "@example.com"))
    )


def error_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors with what their responses are made of: meta, suggestion, link, validation messages, place and trace."""
    e = spread(read(spark, sf_dir, "events")).withColumns({"__uid": F.col("user_id"), "__k": F.get_json_object("props", "$.k").cast("int")})
    x = errors_from_events(e, "__uid", "__k")
    k, uid, eid, message = F.col("__k"), F.col("__uid"), F.col("id"), F.col("message")
    named = F.concat(message, _text(" for u", uid, "@example.com password=pw", k))
    return x.withColumns({
        "message": F.when(eid % 7 == 0, named).when(eid % 11 == 0, "").otherwise(message),
        "meta": F.when(eid % 8 < 7, meta_text(eid, uid, k)),
        "suggestion": F.when(k % 4 == 1, _text("Ask u", uid, "@example.com, then retry")).when(k % 4 == 2, "Retry later").when(k % 4 == 3, ""),
        "link": F.when(k % 3 == 0, _text("https://docs.example.test/errors/", k)),
        "validation": F.when((k % 6 == 0) & (eid % 10 > 0), _validation_map(k, uid)),
        "file": _text("/app/src/file_", k, ".php"),
        "line": k,
        "context": F.when(eid % 3 == 0, _text('{"line":"', eid, '","tenant":{"id":', uid, "}}")),
        "suggestions": F.when(eid % 4 == 0, F.array(F.lit("Retry"), F.lit("Ask support"))),
        "trace": trace_column(eid, F.col("occurrence_count")),
    }).drop("__uid", "__k")


def stored_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors with all that is stored of them: request, user, sightings and resolution too."""
    x = error_responses(spark, sf_dir)
    k, eid = F.col("line"), F.col("id")
    return x.withColumns({
        "request_headers": _text('{"Accept":"application/json","Authorization":"[REDACTED]","X-Request-Id":"req-', eid, '"}'),
        "request_data": F.when(eid % 2 == 0, _text('{"amount":', k, ',"password":"[REDACTED]"}')),
        "resolved_by": F.when(F.col("is_resolved"), "ops"),
        "first_occurred_at": F.col("created_at"),
        "last_occurred_at": F.col("created_at"),
    })


def trace_column(eid: Column, occurrences: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), occurrences + 4),
        lambda i: F.struct(
            F.when(i % 5 != 0, F.concat(F.lit("/app/src/frame_"), i.cast("string"))).alias("file"),
            F.when(i % 7 != 0, (eid % 100 + i).cast("int")).alias("line"),
            F.concat(F.lit("call"), i.cast("string")).alias("function"),
            F.when(i % 2 == 0, F.lit("App\\Service")).alias("class"),
            F.when(i % 2 == 0, F.when(i % 4 == 0, F.lit("::")).otherwise(F.lit("->"))).alias("type"),
            F.array(F.concat(F.lit("password="), eid.cast("string")), F.lit("plain")).alias("args"),
        ),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored stack traces: one frame array per error row."""
    e = errors(spark, sf_dir)
    return e.select("id", trace_column(F.col("id"), F.col("occurrence_count")).alias("trace"))
