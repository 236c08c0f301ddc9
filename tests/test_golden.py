"""Golden cases taken from the behaviour being reproduced (FIXTURES.md §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import classify as CL
from faultline.functions import nested as N
from faultline.functions import redact as RD
from faultline.operators import aggregates as AG
from faultline.operators import filters as P
from faultline.operators import render as RN
from faultline.operators import retry as RT
from faultline.operators import topk as TK


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


def test_email_mask(spark):
    assert "j***@example.com" in one(spark, "User john@example.com tried", RD.redact)
    assert one(spark, "x a@b.co", RD.mask_emails) == "x a@b.co"  # one char local: no stars
    assert one(spark, "mail .bad@x.com", RD.mask_emails) == "mail .bad@x.com"  # invalid left alone


def test_phone_mask(spark):
    out = one(spark, "Contact at +1234567890", RD.redact)
    assert out == "Contact at ******7890"


def test_ip_mask(spark):
    assert "192.*.*.*" in one(spark, "Request from 192.168.1.100", RD.redact)
    assert one(spark, "bad 999.1.1.1", RD.mask_ips) == "bad 999.1.1.1"
    # accented letters around the address are not word characters
    assert one(spark, "é70.23.22.57é", RD.mask_ips) == "é70.*.*.*é"


def test_secret_mask(spark):
    out = one(spark, "password=secret123 and token=abc123def", RD.mask_secrets)
    assert "secret123" not in out and "abc123def" not in out
    assert out == "password=***REDACTED*** and token=***REDACTED***"
    assert one(spark, "Authorization: Bearer eyJabc.def", RD.mask_secrets) == "Authorization: Bearer ***REDACTED***"
    assert one(spark, "card 4111-1111-1111-1111 end", RD.mask_secrets) == "card ****-****-****-**** end"


def test_sanitize_sql(spark):
    out = one(spark, 'SELECT * FROM `users` WHERE `email` = "a@b.com"', RD.sanitize_sql)
    assert out == "SELECT * FROM [table] WHERE [column] = [value]"
    out = one(spark, "SELECT id FROM users JOIN orders ON 1", RD.sanitize_sql)
    assert out == "SELECT id FROM [table] JOIN [table] ON 1"
    assert one(spark, "SELECT 1 FROM users", lambda c: RD.sanitize_sql(c, production=False)) == "SELECT 1 FROM users"


def test_tag_redact(spark):
    assert one(spark, "mail john@example.com now", RD.tag_redact) == "mail [email:REDACTED] now"


def _nested(spark):
    return spark.createDataFrame(
        [((("John", "secret", "john@example.com"), "k1", "t1", "plain", "Contact +1234567890 at 10.1.2.3"),)],
        "p struct<user:struct<name:string,password:string,email:string>,api_key:string,access_token:string,name:string,msg:string>",
    )


def test_mask_nested_contains_match(spark):
    df = _nested(spark)
    out = df.select(N.mask_nested(F.col("p"), df.schema["p"].dataType).alias("o")).first()["o"]
    assert out.user.password == C.MASK_STRING and out.user.name == "John"
    assert out.api_key == C.MASK_STRING and out.access_token == C.MASK_STRING and out.name == "plain"


def test_redact_nested(spark):
    df = _nested(spark)
    out = df.select(N.redact_nested(F.col("p"), df.schema["p"].dataType).alias("o")).first()["o"]
    assert out.user.email == "j***@example.com"
    assert out.msg == "Contact ******7890 at 10.*.*.*"


def test_secure_pipeline_switches_off(spark):
    df = _nested(spark)
    out = df.select(N.secure_pipeline(F.col("p"), df.schema["p"].dataType, mask=False, redact_pii=False).alias("o")).first()["o"]
    assert out.user.password == "secret" and out.msg.startswith("Contact +1234567890")


def test_request_data_exact_keys(spark):
    df = spark.createDataFrame([(("a@b.com", "pw", "k"),)], "p struct<email:string,password:string,api_key:string>")
    out = df.select(N.sanitize_request_data(F.col("p"), df.schema["p"].dataType).alias("o")).first()["o"]
    assert out.email == "a@b.com" and out.password == "[REDACTED]" and out.api_key == "[REDACTED]"


def test_headers(spark):
    df = spark.createDataFrame([({"Authorization": ["Bearer x"], "Accept": ["application/json", "*/*"]},)], "h map<string,array<string>>")
    out = df.select(N.sanitize_headers(F.col("h")).alias("o")).first()["o"]
    assert out == {"Authorization": "[REDACTED]", "Accept": "application/json"}


ERR_SCHEMA = (
    "id long, error_id string, exception_class string, error_code string, message string, status_code int, "
    "request_method string, request_url string, user_id string, is_resolved boolean, occurrence_count int, "
    "response_ms double, created_at timestamp_ntz, updated_at timestamp_ntz, resolved_at timestamp_ntz"
)
NOW = dt.datetime(2024, 1, 31)


def _err(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(id=i + 1, error_id=f"e{i}", exception_class="App\\Exceptions\\NotFoundHttpException", error_code="NOT_FOUND",
                    message="Not found", status_code=404, request_method="GET", request_url="https://x/a", user_id=None,
                    is_resolved=False, occurrence_count=1, response_ms=1.0, created_at=NOW - dt.timedelta(hours=1),
                    updated_at=NOW - dt.timedelta(hours=1), resolved_at=None)
        base.update(r)
        full.append(base)
    return spark.createDataFrame(full, ERR_SCHEMA)


def test_analytics_total(spark):
    rows = [{} for _ in range(10)] + [{"created_at": NOW - dt.timedelta(days=2)} for _ in range(5)]
    rows += [{"created_at": NOW - dt.timedelta(days=6)} for _ in range(3)] + [{"created_at": NOW - dt.timedelta(days=9)}]
    k = AG.analytics_kpis(_err(spark, rows), NOW, 7).first()
    assert k.total_errors == 18


def test_scopes(spark):
    e = _err(spark, [{"is_resolved": True}, {}])
    assert P.unresolved(e).count() == 1
    e = _err(spark, [{"status_code": 500}, {"status_code": 404}])
    assert P.by_status_code(e, 500).count() == 1
    e = _err(spark, [{"created_at": NOW - dt.timedelta(days=2)}, {"created_at": NOW - dt.timedelta(days=3)}, {}])
    assert P.recent(e, NOW, 24).count() == 1


def test_live_feed_shape(spark):
    e = _err(spark, [{"created_at": NOW - dt.timedelta(minutes=i)} for i in range(100)])
    out = TK.live_errors(e, 10)
    assert out.count() == 10 and len(out.columns) == 11


def test_validation_of_parameters():
    with pytest.raises(ValueError):
        P.check_days(0)
    with pytest.raises(ValueError):
        P.check_per_page(101)
    with pytest.raises(ValueError):
        P.check_range("2024-01-10", "2024-01-01")


def test_occurrence_bump(spark):
    from faultline.operators.joins import error_occurrences
    from faultline.operators.maintenance import upsert_errors

    table = error_occurrences(_err(spark, [{"error_id": "x"}] * 3))
    batch = _err(spark, [{"error_id": "x"}])
    out = upsert_errors(table, batch).first()
    assert out.occurrence_count == 4


def test_categories_and_titles(spark):
    df = spark.createDataFrame([(401,), (403,), (500,), (404,)], "s int")
    cats = [r.c for r in df.select(CL.error_category(F.col("s")).alias("c")).collect()]
    assert cats == ["authentication", "authorization", "internal", "not_found"]
    assert df.select(CL.status_title(F.col("s")).alias("t")).collect()[3].t == "Not Found"


@pytest.mark.parametrize(
    "message,kind",
    [
        ("Request timeout", "timeout"),
        ("connection refused", "connection"),
        ("rate_limit hit", "rate_limit"),
        ("authentication failed", "authentication"),
        ("validation failed", "validation"),
        ("something else", "general"),
    ],
)
def test_suggestion_types(spark, message, kind):
    assert one(spark, message, lambda c: CL.recovery_suggestion(c).getField("type")) == kind


@pytest.mark.parametrize("message", ["Connection timeout", "Network error", "HTTP 503 error", "HTTP 502 error"])
def test_transient(spark, message):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(CL.is_transient(F.col("m"), F.lit(500)).alias("t")).first().t


def test_validation_fanout(spark):
    v = spark.createDataFrame([(1, {"email": ["The email is required.", "Must be a valid email."], "age": ["Must be numeric."]})],
                              "id long, errors map<string,array<string>>")
    out = RN.validation_fanout(v).collect()
    assert len(out) == 3
    codes = {(r.field, r.pos): r.code for r in out}
    assert codes[("email", 1)] == "FIELD_REQUIRED" and codes[("email", 2)] == "INVALID_EMAIL" and codes[("age", 1)] == "MUST_BE_NUMERIC"


def _attempts(spark, rows):
    return spark.createDataFrame(
        [(1, (i,), ok, st, msg) for i, (ok, st, msg) in enumerate(rows)], "call_id long, ord struct<n:int>, ok boolean, status_code int, message string"
    )


def test_retry_non_transient_stops(spark):
    r = RT.retry_outcomes(_attempts(spark, [(False, 422, "Invalid input data"), (True, 200, "ok")])).first()
    assert r.tries == 1 and r.outcome == "failed" and r.backoff_ms == 0.0


def test_retry_max(spark):
    cfg = C.RetryConfig(max_retries=2)
    r = RT.retry_outcomes(_attempts(spark, [(False, 503, "HTTP 503 error")] * 4), cfg).first()
    assert r.tries == 2 and r.outcome == "max_retries" and r.backoff_ms == 1000.0


def test_retry_success_after_transient(spark):
    r = RT.retry_outcomes(_attempts(spark, [(False, 500, "Connection timeout"), (False, 500, "Network error"), (True, 200, "")])).first()
    assert r.tries == 3 and r.outcome == "success" and r.backoff_ms == 3000.0


def test_granularity_choice():
    from faultline.operators.trends import granularity_for

    assert granularity_for("1h") == "hour" and granularity_for("24h") == "hour"
    assert granularity_for("7d") == "day" and granularity_for("30d") == "day" and granularity_for("90d") == "week"


def test_manual_breaker_events(spark):
    from faultline.operators.maintenance import breaker_record

    cb = spark.createDataFrame(
        [(1, "svc", None, "closed", 2, 3, 60, 3, None, None, None)],
        "id long, service string, operation string, state string, failure_count int, failure_threshold int, recovery_timeout int, "
        "success_threshold int, last_failure_at timestamp_ntz, opened_at timestamp_ntz, next_attempt_at timestamp_ntz",
    )
    opened = breaker_record(cb, F.col("id") == 1, ok=False, as_of=NOW).first()
    assert opened.state == "open" and opened.failure_count == 3 and opened.next_attempt_at == NOW + dt.timedelta(seconds=60)
    later = NOW + dt.timedelta(seconds=61)
    half = breaker_record(breaker_record(cb, F.col("id") == 1, ok=False, as_of=NOW), F.col("id") == 1, ok=True, as_of=later).first()
    assert half.state == "half_open" and half.failure_count == 3


def test_approx_distinct_close(spark, sf):
    from faultline.sources import tables as T

    e = T.errors(spark, sf)
    exact = AG.analytics_kpis(e, T.AS_OF, 7).first()
    approx = AG.analytics_kpis(e, T.AS_OF, 7, approx=True).first()
    assert approx.total_errors == exact.total_errors
    assert abs(approx.unique_errors - exact.unique_errors) <= 0.1 * exact.unique_errors + 1


def test_breaker_identifier_and_overlapping_categories(spark):
    df = spark.createDataFrame([("svc", None, 500), ("svc", "op", 429)], "s string, o string, c int")
    rows = df.select(CL.breaker_identifier(F.col("s"), F.col("o")).alias("i"), CL.category_list(F.col("c")).alias("k")).collect()
    assert rows[0].i == "circuit_breaker:svc" and rows[1].i == "circuit_breaker:svc:op"
    assert rows[0].k == ["server_error", "critical"] and rows[1].k == ["client_error", "recoverable"]


def test_auto_interval():
    from faultline.operators.trends import auto_interval

    assert auto_interval(1) == "hour" and auto_interval(2) == "day"


def test_retry_follows_the_strategy_of_its_service(spark):
    log = [(c, (i,), False, 503, "Network error", svc) for c, svc in ((1, "a"), (2, "b"), (3, "c"), (4, None)) for i in range(6)]
    df = spark.createDataFrame(log, "call_id long, ord struct<n:int>, ok boolean, status_code int, message string, service string")
    rules = spark.createDataFrame([("a", 5, 10, 3.0), ("b", 1, 10, 2.0), ("b", 4, 1, 1.0), ("c", 0, 1, 1.0)], "service string, max_retries int, base_delay_ms int, multiplier double")
    out = {r.call_id: (r.tries, r.outcome, r.backoff_ms) for r in RT.retry_outcomes(df, strategies=rules).collect()}
    # two strategies of one service: the one with the fewest retries; a strategy without retries does not count
    assert out == {1: (5, "max_retries", 400.0), 2: (1, "max_retries", 0.0), 3: (3, "max_retries", 3000.0), 4: (3, "max_retries", 3000.0)}
    plans = RT.backoff_schedule(df, rules.where("max_retries > 0")).where("service = 'b'").collect()
    assert plans == []


@pytest.mark.parametrize("days,limit", [(0, 10), (366, 10), (7, 0), (7, 101)])
def test_windows_and_limits_are_checked(spark, days, limit):
    from faultline.operators import trends as TR

    e = _err(spark, [{}])
    with pytest.raises(ValueError):
        TK.top_errors(e, NOW, limit, days)
    with pytest.raises(ValueError):
        AG.top_error_groups(e, NOW, days, limit)
    if limit == 10:
        for fn in (AG.status_distribution, TR.trend, TR.error_rate_series):
            with pytest.raises(ValueError):
                fn(e, NOW, days)


def test_page_total_and_unhealthy_breakers(spark):
    e = _err(spark, [{"status_code": 500}, {"status_code": 500}, {}])
    assert P.page_total(e, {"status_code": 500}).first().total == 2
    cb = spark.createDataFrame(
        [("a", None, "open", 5, NOW - dt.timedelta(seconds=1)), ("b", None, "open", 5, NOW), ("c", None, "half_open", 1, None), ("d", None, "closed", 0, None)],
        "service string, operation string, state string, failure_count int, next_attempt_at timestamp_ntz",
    )
    assert {r.service: r.can_attempt for r in P.breakers_unhealthy(cb, NOW).collect()} == {"a": True, "b": False, "c": True}


def test_nested_trend_rows_are_bounded_lists(spark):
    from faultline.operators import joins as J

    e = spark.createDataFrame([(i, f"e{i}", "HOT") for i in range(50)] + [(90, "x", None), (91, "y", "NONE")], "id long, error_id string, error_code string")
    days = [(dt.date(2024, m, d), "HOT", s, m * d) for m in (1, 2) for d in (3, 1, 2) for s in (500, 404)]
    trends = spark.createDataFrame([*days, (dt.date(2024, 1, 1), None, 500, 9)], "date date, error_code string, status_code int, count long")
    out = J.errors_with_trend_rows(e, trends).collect()
    assert len(out) == 50 * 2 + 2
    hot = [r for r in out if r.id == 7]
    assert sorted(r.month.month for r in hot) == [1, 2]
    january = next(r for r in hot if r.month.month == 1)
    assert [(t.date.day, t.status_code) for t in january.trends] == [(1, 404), (1, 500), (2, 404), (2, 500), (3, 404), (3, 500)]
    assert all(r.trends == [] and r.month is None for r in out if r.id in (90, 91))
