"""Error bodies: mixed-type metadata, validation errors, precedence, places, security, debug and switches."""

import datetime as dt
import json

import pytest

from faultline import config as C
from faultline.operators import render as RN

SCHEMA = (
    "id long, error_id string, exception_class string, error_code string, message string, status_code int, created_at timestamp_ntz, "
    "meta string, suggestion string, link string, validation map<string,array<string>>, file string, line int, "
    "trace array<struct<file:string,line:int,function:string,class:string,type:string,args:array<string>>>, "
    "previous array<struct<exception:string,message:string,file:string,line:int>>, context string, links string"
)
FORMATS = ("jsend", "rfc7807", "jsonapi", "graphql")


VALIDATION = {
    "exception_class": "Illuminate\\Validation\\ValidationException", "error_code": None, "status_code": 400, "message": "The given data was invalid.",
    "validation": {"email": ["The email field is required."], "password": ["The password must be at least 8 characters.", "Call john@example.com"]},
    "meta": {"ignored": 1}, "suggestion": "ignored", "link": "ignored",
}



COLLIDING = dict.fromkeys(("timestamp", "error_id", "suggestion", "type", "title", "detail", "instance", "code", "category", "errorId", "help"), "m") | {"status": 1}
META = {"key": "value", "count": 42, "deep": {"list": [1, 2.5, None, {"ok": True}]}, "none": None}
SECRETS = {
    "message": "User john@example.com with password=secret123", "suggestion": "Mail a.b@example.com",
    "meta": {"email": "john@example.com", "password": "secret123", "x": [{"Api_Key": 5}]},
}
STATUS = [(400, "fail", "client"), (401, "fail", "authentication"), (403, "fail", "authorization"), (429, "fail", "rate_limit"), (500, "error", "internal"), (200, "error", "internal"), (None, "error", "internal")]
PLACES = [
    ({"line": 5, "column": 10}, [{"line": 5, "column": 10}], None),
    ({"line": "12", "column": " 3x", "path": ["user", 0]}, [{"line": 12, "column": 3}], ["user", 0]),
    ({"line": 2.9, "column": None}, [{"line": 2, "column": 0}], None),
    ({"line": True, "column": "x"}, [{"line": 1, "column": 0}], None),
    ({"locations": [{"line": 1, "column": 2}], "line": 9, "column": 9}, [{"line": 1, "column": 2}], None),
    ({"locations": "none", "line": 4, "column": 4, "path": "none"}, [{"line": 4, "column": 4}], None),
    ({"locations": [], "line": 9, "column": 9, "path": []}, None, None),
    ({"line": 5}, None, None),
]
CASES = {
    "plain": {"message": "Resource not found", "error_code": "RESOURCE_NOT_FOUND", "status_code": 404},
    "meta": {"meta": META},
    "collide": {"meta": COLLIDING, "suggestion": "Try again later", "link": "https://docs.example.com/errors"},
    "validation": VALIDATION,
    "no fields": VALIDATION | {"validation": None},
    "no message": VALIDATION | {"validation": {"a": []}},
    "secrets": SECRETS,
    "empty": {"message": ""},
    "causes": {"trace": [(None, None, "f", None, "->", ["password=x"])] * 12, "previous": [(f"E{i}", "mail john@example.com", "/c.php", i) for i in range(8)]},
} | {f"status {s}": {"status_code": s} for s, _, _ in STATUS} | {f"place {i}": {"meta": m | {"kept": 1}} for i, (m, _, _) in enumerate(PLACES)}


@pytest.fixture(scope="module")
def got(spark):
    """(format, config) -> name of the case -> (status, body)."""
    base = {"id": 1, "error_id": "err_x", "exception_class": "App\\ApiException", "error_code": "API_ERROR", "message": "Error", "status_code": 500}
    base |= {"created_at": dt.datetime(2024, 1, 2, 3, 4, 5), "file": "/a.php", "line": 7}
    base |= dict.fromkeys(("meta", "suggestion", "link", "validation", "trace", "previous", "context", "links"))
    rows = [base | over | {"id": i} for i, over in enumerate(CASES.values())]
    rows = [r | {"meta": json.dumps(r["meta"]) if r["meta"] else None} for r in rows]
    df, made = spark.createDataFrame(rows, SCHEMA).coalesce(1).cache(), {}

    def of(fmt, cfg=C.RenderConfig()):
        if (fmt, cfg) not in made:
            out = RN.render(df, fmt, cfg).collect()
            made[fmt, cfg] = {name: (r.http_status, json.loads(r.body)) for name, r in zip(CASES, sorted(out))}
        return made[fmt, cfg]

    return of


def test_plain_bodies(got):
    out = {f: got(f)["plain"] for f in FORMATS}
    assert {s for s, _ in out.values()} == {404}
    ts = "2024-01-02T03:04:05+00:00"
    assert out["jsend"][1] == {"status": "fail", "message": "Resource not found", "code": "RESOURCE_NOT_FOUND", "data": {"error_id": "err_x", "timestamp": ts}}
    assert out["rfc7807"][1] == {
        "type": "https://api.example.com/errors/resource-not-found", "title": "Not Found", "status": 404, "detail": "Resource not found", "instance": "err_x",
    }
    error = {"status": "404", "code": "RESOURCE_NOT_FOUND", "title": "Not Found", "detail": "Resource not found", "id": "err_x", "meta": {"timestamp": ts}}
    assert out["jsonapi"][1] == {"errors": [error]}
    extensions = {"code": "RESOURCE_NOT_FOUND", "category": "not_found", "timestamp": ts, "errorId": "err_x"}
    assert out["graphql"][1] == {"errors": [{"message": "Resource not found", "extensions": extensions}], "data": None}


@pytest.mark.parametrize("status,jsend,category", STATUS)
def test_status(got, status, jsend, category):
    http, b = got("jsend")[f"status {status}"]
    assert b["status"] == jsend and http == (status if status and status >= 400 else 500)
    assert got("graphql")[f"status {status}"][1]["errors"][0]["extensions"]["category"] == category


def test_meta_keeps_its_types(got):
    homes = [got("jsend")["meta"][1]["data"], got("rfc7807")["meta"][1], got("jsonapi")["meta"][1]["errors"][0]["meta"], got("graphql")["meta"][1]["errors"][0]["extensions"]]
    for home in homes:
        assert {k: v for k, v in home.items() if k in META} == META


def test_precedence(got):
    data = got("jsend")["collide"][1]["data"]
    assert list(data)[:4] == ["timestamp", "error_id", "suggestion", "type"]  # replaced in place
    assert data["error_id"] == "err_x" and data["suggestion"] == "Try again later" and data["documentation"] == "https://docs.example.com/errors"
    problem = got("rfc7807")["collide"][1]
    assert list(problem)[:5] == ["type", "title", "status", "detail", "instance"]
    assert [problem[k] for k in list(problem)[:5]] == ["m", "m", 1, "m", "m"]
    assert problem["suggestion"] == "Try again later" and problem["help"] == "https://docs.example.com/errors"
    error = got("jsonapi")["collide"][1]["errors"][0]
    assert error["status"] == "500" and error["meta"]["suggestion"] == "Try again later" and error["links"] == {"about": "https://docs.example.com/errors"}
    ext = got("graphql")["collide"][1]["errors"][0]["extensions"]
    assert ext["code"] == ext["category"] == ext["timestamp"] == ext["errorId"] == "m"
    assert ext["suggestion"] == "Try again later" and ext["documentation"] == "https://docs.example.com/errors"


FIELDS = {
    "email": {"message": "The email field is required.", "code": "FIELD_REQUIRED"},
    "password": {"message": "The password must be at least 8 characters.", "code": "VALIDATION_ERROR"},
}


def test_validation(got):
    status, b = got("jsend")["validation"]
    assert status == 422 and list(b) == ["status", "data", "message"] and b["status"] == "fail" and b["data"] == FIELDS
    status, b = got("rfc7807")["validation"]
    assert status == 422 and b == {
        "type": "https://api.example.com/errors/validation-error", "title": "Validation Failed", "status": 422,
        "detail": "The given data was invalid.", "instance": "err_x", "errors": FIELDS,
    }
    errors = {e["detail"]: e for e in got("jsonapi")["validation"][1]["errors"]}
    assert set(errors) == {"The email field is required.", "The password must be at least 8 characters.", "Call j***@example.com"}
    assert errors["Call j***@example.com"] == {
        "status": "422", "code": "VALIDATION_ERROR", "title": "Validation Error", "detail": "Call j***@example.com",
        "source": {"pointer": "/data/attributes/password"},
    }
    errors = {e["message"]: e["extensions"] for e in got("graphql")["validation"][1]["errors"]}
    ext = {"code": "VALIDATION_ERROR", "category": "validation", "timestamp": "2024-01-02T03:04:05+00:00", "errorId": "err_x", "field": "email", "validation": True}
    assert len(errors) == 3 and errors["The email field is required."] == ext


def test_validation_switches(got):
    plain = C.RenderConfig(include_error_codes=False)
    assert got("jsend", plain)["validation"][1]["data"] == {"email": "The email field is required.", "password": C.MASK_STRING}
    open_ = C.RenderConfig(include_error_codes=False, redaction=C.RedactionConfig(mask_sensitive_data=False, pii_redaction=False))
    assert got("jsend", open_)["validation"][1]["data"]["password"].startswith("The password")
    assert got("jsend")["no fields"][1]["data"] == [] and got("jsonapi")["no fields"][1] == {"errors": []}
    assert got("jsend")["no message"][1]["data"] == {"a": {"message": "Validation failed", "code": "VALIDATION_ERROR"}}


@pytest.mark.parametrize("i", range(len(PLACES)))
def test_graphql_places(got, i):
    _, locations, path = PLACES[i]
    error = got("graphql")[f"place {i}"][1]["errors"][0]
    assert error.get("locations") == locations and error.get("path") == path
    assert error["extensions"]["kept"] == 1 and not set(error["extensions"]) & {"locations", "line", "column", "path"}


def test_security(got):
    for fmt in FORMATS:
        text = json.dumps(got(fmt)["secrets"][1])
        assert "john@" not in text and "secret123" not in text and "a.b@" not in text and "j***@example.com" in text and f'"Api_Key": "{C.MASK_STRING}"' in text
    off = C.RenderConfig(include_error_codes=False, redaction=C.RedactionConfig(mask_sensitive_data=False, pii_redaction=False))
    assert got("jsend", off)["secrets"][1]["data"]["password"] == "secret123"
    assert got("jsend", C.RenderConfig(hide_message=True))["secrets"][1]["message"] == C.HIDDEN_MESSAGE
    assert got("jsend")["empty"][1]["message"] == C.GENERIC_MESSAGE


def test_switches_and_debug(got):
    off = C.RenderConfig(include_error_id=False, include_timestamp=False, include_suggestions=False)
    assert "data" not in got("jsend", off)["plain"][1] and "instance" not in got("rfc7807", off)["plain"][1]
    assert set(got("jsonapi", off)["plain"][1]["errors"][0]) == {"status", "code", "title", "detail"}
    cfg = C.RenderConfig(include_debug=True, include_trace=True, include_exception_chain=True)
    debug = got("graphql", cfg)["causes"][1]["errors"][0]["extensions"]["debug"]
    assert debug["exception"] == "App\\ApiException" and debug["file"] == "/a.php" and debug["line"] == 7
    assert len(debug["trace"]) == 10 and debug["trace"][0]["file"] == "unknown" and debug["trace"][0]["args"] == ["password=***REDACTED***"]
    depth, cause = 0, debug["previous"]
    while cause:
        assert cause["exception"] == f"E{depth}" and cause["message"] == "mail j***@example.com"
        depth, cause = depth + 1, cause.get("previous")
    assert depth == 6 and cause == []
    error = got("jsonapi", cfg)["plain"][1]["errors"][0]
    assert error["source"] == {"file": "/a.php", "line": 7} and "trace" not in error["meta"]["debug"]


def test_few_columns(spark):
    df = spark.createDataFrame([(1, "e", "FooBarException", None, None, 503, None)], ", ".join(SCHEMA.split(", ")[:7]))
    for fmt in FORMATS:
        assert "foo_bar" in RN.render(df, fmt).first().body.replace("-", "_")
    with pytest.raises(ValueError):
        RN.render(df, "xml")


def test_records_are_raw(spark):
    row = (1, "e1", "X", None, "mail john@example.com", 7, dt.datetime(2024, 1, 1), '{"password":"p"}', None, "l", None, "/a", 3, [(None, 1, "f", "C", "::", ["a"])], None, '{"line":"own","x":[1]}', '{"self":"/e"}')
    df = spark.createDataFrame([row], SCHEMA)
    r = RN.assemble_error_records(df).first()
    assert (r.error_code, r.message, r.status_code) == (None, "mail john@example.com", 500)
    assert json.loads(r.context) == {"file": "/a", "line": "own", "trace": [], "x": [1]}
    assert json.loads(r.meta) == {"password": "p", "links": {"self": "/e"}}
    r = RN.assemble_error_records(df, C.RenderConfig(include_debug=True)).first()
    assert json.loads(r.context)["trace"] == [{"file": "unknown", "line": 1, "function": "f", "class": "C", "type": "::"}]


def test_error_context(spark):
    df = spark.createDataFrame([("e1", dt.datetime(2024, 1, 1), "r1", "5", None), ("e2", None, None, None, None)], "error_id string, created_at timestamp_ntz, request_id string, user_id string, user_type string")
    plain = [json.loads(r[0]) for r in df.select(RN.error_context(df)).collect()]
    assert plain == [{"error_id": "e1", "timestamp": "2024-01-01T00:00:00+00:00", "request_id": "r1"}, {"error_id": "e2"}]
    cfg = C.RenderConfig(include_error_id=False, include_timestamp=False, include_request_id=False, include_user_info=True)
    assert [json.loads(r[0]) for r in df.select(RN.error_context(df, cfg)).collect()] == [{"user": {"id": "5", "type": "User"}}, {}]
