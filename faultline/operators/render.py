"""Error bodies as table jobs.

Each renderer maps an errors DataFrame to ``(id, http_status, body)``.  Bodies
are lists of members (key, JSON text) that are merged by key precedence, so
free-form metadata of any depth and of mixed types keeps its values and order
and never forces a wide union schema.  Members without a value are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import classify as CL
from faultline.functions import formatting as FMT
from faultline.functions import jsontext as J
from faultline.functions import redact as RD

RENDERERS: dict[str, Callable[[DataFrame, C.RenderConfig], DataFrame]] = {}


def register_renderer(name: str, fn: Callable[[DataFrame, C.RenderConfig], DataFrame]) -> None:
    """Add a custom renderer ``fn(errors, cfg) -> (id, http_status, body)``."""
    RENDERERS[name] = fn


def render(err: DataFrame, fmt: str, cfg: C.RenderConfig = C.RenderConfig()) -> DataFrame:
    if fmt not in RENDERERS:
        raise ValueError(f"unknown format {fmt!r}; known: {sorted(RENDERERS)}")
    return RENDERERS[fmt](err, cfg)


# ---- shared fields ---------------------------------------------------------------


def secure_text(c: Column, cfg: C.RenderConfig) -> Column:
    """The response security pass on a string leaf: secrets, then PII."""
    r = cfg.redaction
    return RD.redact(RD.mask_secrets(c, r.mask_sensitive_data), r.pii_redaction)


def public_text(c: Column, cfg: C.RenderConfig) -> Column:
    """A text of the error itself: PII first, then the secrets that are left.

    The response pass would redact once more, which changes nothing: what the
    masks leave behind holds no match.
    """
    r = cfg.redaction
    return RD.mask_secrets(RD.redact(c, r.pii_redaction), r.mask_sensitive_data)


def public_message(message: Column, cfg: C.RenderConfig = C.RenderConfig()) -> Column:
    """Empty -> default text; PII redacted; hidden behind the generic text when configured."""
    if cfg.hide_message:
        return F.lit(C.HIDDEN_MESSAGE)
    m = F.coalesce(F.nullif(message, F.lit("")), F.lit(C.GENERIC_MESSAGE))
    return RD.redact(m, cfg.redaction.pii_redaction)


#: Columns that an errors table may lack, and what stands in for them.
OPTIONAL = {
    "meta": "string",  # JSON text
    "suggestion": "string",
    "link": "string",
    "validation": "map<string,array<string>>",  # field -> messages
    "file": "string",
    "line": "int",
    "trace": "array<struct<file:string,line:int,function:string,class:string,type:string,args:array<string>>>",
    "previous": "array<struct<exception:string,message:string,file:string,line:int>>",  # nearest cause first
    "context": "string",  # JSON text
    "suggestions": "array<string>",
    "links": "string",  # JSON text
    "request_id": "string",
    "user_id": "string",
    "user_type": "string",
}


def _with_optional(err: DataFrame) -> DataFrame:
    return err.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in err.columns})


#: JSON text of a string; null stays null.
_text = J.quote


def is_validation(exception_class: Column) -> Column:
    return F.coalesce(CL.class_basename(exception_class) == C.VALIDATION_EXCEPTION, F.lit(False))


def error_context(err: DataFrame, cfg: C.RenderConfig = C.RenderConfig()) -> Column:
    """The context object (JSON text) of each error by the switches of ``cfg``.

    error_id, timestamp, request_id, then user {id, type} for known users.  A
    column that is null or absent leaves its member out.
    """
    e = set(err.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in e else F.lit(None).cast("string")

    user = J.obj(J.members(("id", _text(col("user_id"))), ("type", _text(F.coalesce(col("user_type"), F.lit("User"))))))
    parts = [
        ("error_id", _text(col("error_id")), cfg.include_error_id),
        ("timestamp", _text(FMT.iso8601(F.col("created_at"))), cfg.include_timestamp),
        ("request_id", _text(col("request_id")), cfg.include_request_id),
        ("user", F.when(col("user_id").isNotNull(), user), cfg.include_user_info),
    ]
    return J.obj(J.members(*((k, v) for k, v, on in parts if on)))


def _frames(trace: Column, cfg: C.RenderConfig) -> Column:
    return F.when(trace.isNotNull(), F.to_json(trace_head(trace, 10, cfg.redaction), {"ignoreNullFields": "false"}))


def _causes(previous: Column, cfg: C.RenderConfig) -> Column:
    """The causes nested in each other, nearest first, six deep; null if there is none."""
    start = F.when(F.size(previous) > C.CAUSES_DEPTH, F.lit("[]")).cast("string")

    def wrap(inner: Column, x: Column) -> Column:
        return J.obj(J.members(
            ("exception", _text(x.getField("exception"))), ("message", _text(public_text(x.getField("message"), cfg))),
            ("file", _text(x.getField("file"))), ("line", x.getField("line").cast("string")), ("previous", inner),
        ))

    return F.aggregate(F.reverse(F.slice(previous, 1, C.CAUSES_DEPTH)), start, wrap)


def _debug(cfg: C.RenderConfig) -> Column:
    """The debug object (exception, file, line, trace, previous), or null when switched off."""
    if not cfg.include_debug:
        return F.lit(None).cast("string")
    return J.obj(J.members(
        ("exception", _text(F.col("exception_class"))), ("file", _text(F.col("file"))), ("line", F.col("line").cast("string")),
        ("trace", _frames(F.col("trace"), cfg) if cfg.include_trace else F.lit(None).cast("string")),
        ("previous", F.when(F.size("previous") > 0, _causes(F.col("previous"), cfg)) if cfg.include_exception_chain else F.lit(None).cast("string")),
    ))


def _fields(err: DataFrame, cfg: C.RenderConfig) -> DataFrame:
    """What the bodies are made of, as JSON texts; null for what is left out.

    A row of a validation exception has status 422 and its own code, and takes
    nothing from meta, suggestion or link.  All texts of a row pass the masks
    in one list, so a pass is one expression however many texts there are.
    """
    e = _with_optional(err)
    invalid = is_validation(F.col("exception_class"))
    status = CL.response_status(F.col("status_code"), F.col("exception_class"))
    code = F.when(invalid, C.VALIDATION_DEFAULT_CODE).otherwise(F.coalesce("error_code", CL.derived_error_code(F.col("exception_class"))))
    none = F.lit(None).cast("string")
    message = F.coalesce(F.nullif("message", F.lit("")), F.lit(C.GENERIC_MESSAGE))
    suggestion = F.when(~invalid, F.nullif("suggestion", F.lit("")))
    # the error's own texts lose PII before the response pass
    own = F.array(none if cfg.hide_message else message, suggestion if cfg.include_suggestions else none)
    own = F.transform(own, lambda t: RD.redact(t, cfg.redaction.pii_redaction))
    others = F.array(code, F.col("error_id") if cfg.include_error_id else none, F.when(~invalid, F.nullif("link", F.lit(""))))
    texts = F.transform(F.concat(own, others), lambda t: secure_text(t, cfg))
    fields = F.coalesce(F.map_entries("validation"), F.array().cast("array<struct<key:string,value:array<string>>>"))
    first = e.select(
        "id", "error_id", "exception_class", "file", "line",
        invalid.alias("invalid"),
        status.alias("http_status"),
        texts.alias("texts"),
        (_text(FMT.iso8601(F.col("created_at"))) if cfg.include_timestamp else none).alias("ts"),
        J.entries(F.when(~invalid, J.secure_json(F.col("meta"), cfg.redaction))).alias("meta"),
        CL.error_category(status, F.col("exception_class")).alias("category"),
        F.when(invalid, fields).alias("fields"),
        _debug(cfg).alias("debug"),
    )
    text = [F.get("texts", F.lit(i)) for i in range(5)]
    return first.withColumns({
        "msg": _q(C.HIDDEN_MESSAGE) if cfg.hide_message else _text(text[0]),
        "sugg": _text(text[1]),
        "code": text[2],
        "eid": _text(text[3]),
        "link": _text(text[4]),
    })


def _q(text: str) -> Column:
    return F.lit(f'"{text}"')


def _field_errors(cfg: C.RenderConfig) -> Column:
    """field -> first message, with its code unless that is switched off."""

    def one(x: Column) -> Column:
        first = F.coalesce(F.get(x.getField("value"), F.lit(0)), F.lit(C.VALIDATION_MESSAGE))
        if cfg.include_error_codes:
            body = lambda m: J.obj(J.members(("message", _text(RD.mask_secrets(m, cfg.redaction.mask_sensitive_data))), ("code", _text(CL.validation_code(m)))))
            return RD.let(RD.redact(first, cfg.redaction.pii_redaction), body)
        text = _text(public_text(first, cfg))
        hide = J.holds(x.getField("key"), cfg.redaction.mask_patterns) if cfg.redaction.mask_sensitive_data else F.lit(False)
        return F.when(hide, _q(C.MASK_STRING)).otherwise(text)

    made = F.transform("fields", lambda x: F.struct(x.getField("key").alias("key"), one(x).alias("value")))
    return F.when(F.size("fields") > 0, J.obj(made)).otherwise("[]")


def _each_message(make: Callable[[Column, Column, Column], Column], cfg: C.RenderConfig) -> Column:
    """The list of ``make(field, message, message as it came)`` over all messages of all fields, secured in one pass."""

    def of_field(x: Column) -> Column:
        texts = F.concat(F.array(x.getField("key")), x.getField("value"))
        return RD.let(F.transform(texts, lambda t: secure_text(t, cfg)), lambda s: F.transform(x.getField("value"), lambda m, i: make(F.get(s, F.lit(0)), F.get(s, i + 1), m)))

    return J.listed(F.flatten(F.transform("fields", of_field)))


# ---- renderers -------------------------------------------------------------------


def render_jsend(err: DataFrame, cfg: C.RenderConfig = C.RenderConfig()) -> DataFrame:
    """JSend: own members (error_id, timestamp, suggestion, documentation, debug) win over meta in ``data``."""
    f = _fields(err, cfg)
    status = _text(CL.jsend_status(F.col("http_status")))
    own = J.members(("error_id", F.col("eid")), ("timestamp", F.col("ts")), ("suggestion", F.col("sugg")), ("documentation", F.col("link")), ("debug", F.col("debug")))
    data = RD.let(J.merged(F.col("meta"), own), lambda d: F.when(F.size(d) > 0, J.obj(d)))
    one = J.obj(J.members(("status", status), ("message", F.col("msg")), ("code", _text(F.col("code"))), ("data", data)))
    many = J.obj(J.members(("status", status), ("data", _field_errors(cfg)), ("message", F.col("msg"))))
    return f.select("id", "http_status", F.when(F.col("invalid"), many).otherwise(one).alias("body"))


def render_problem(err: DataFrame, cfg: C.RenderConfig = C.RenderConfig()) -> DataFrame:
    """RFC 7807: meta is written over type, title, status, detail and instance; suggestion, help and debug over meta.

    A meta key with dots stays one key.
    """
    f = _fields(err, cfg)
    title = F.when(F.col("invalid"), C.VALIDATION_TITLE).otherwise(CL.status_title(F.col("http_status")))
    base = J.members(
        ("type", _text(CL.problem_type_uri(F.col("code"), cfg.type_prefix))), ("title", _text(title)),
        ("status", F.col("http_status").cast("string")), ("detail", F.col("msg")), ("instance", F.col("eid")),
        ("errors", F.when(F.col("invalid"), _field_errors(cfg))),
    )
    tail = J.members(("suggestion", F.col("sugg")), ("help", F.col("link")), ("debug", F.col("debug")))
    body = J.obj(RD.let(J.merged(base, F.col("meta")), lambda m: J.merged(m, tail)))
    return f.select("id", "http_status", body.alias("body"))


def render_jsonapi(err: DataFrame, cfg: C.RenderConfig = C.RenderConfig()) -> DataFrame:
    """JSON:API: one error object, or one for each validation message."""
    f = _fields(err, cfg)
    own = J.members(("timestamp", F.col("ts")), ("suggestion", F.col("sugg")), ("debug", F.col("debug")))
    meta = RD.let(J.merged(F.col("meta"), own), lambda m: F.when(F.size(m) > 0, J.obj(m)))
    source = J.obj(J.members(("file", _text(F.col("file"))), ("line", F.col("line").cast("string"))))
    one = J.obj(J.members(
        ("status", _text(F.col("http_status").cast("string"))), ("code", _text(F.col("code"))),
        ("title", _text(CL.status_title(F.col("http_status")))), ("detail", F.col("msg")), ("id", F.col("eid")),
        ("source", source if cfg.include_debug else F.lit(None).cast("string")), ("meta", meta),
        ("links", F.when(F.col("link").isNotNull(), J.obj(J.members(("about", F.col("link")))))),
    ))

    def each(field: Column, message: Column, raw: Column) -> Column:
        return J.obj(J.members(
            ("status", _q(str(C.STATUS_VALIDATION))), ("code", _text(CL.validation_code(raw))), ("title", _q(C.VALIDATION_ITEM_TITLE)),
            ("detail", _text(message)), ("source", J.obj(J.members(("pointer", _text(CL.json_pointer(field)))))),
        ))

    errors = F.when(F.col("invalid"), _each_message(each, cfg)).otherwise(J.listed(F.array(one)))
    return f.select("id", "http_status", F.concat(F.lit('{"errors":'), errors, F.lit("}")).alias("body"))


def _as_int(value: Column) -> Column:
    """A JSON value as a whole number: numbers are cut, leading digits of strings count, true is 1, other values 0."""
    text = F.when(value.startswith('"'), J.unquote(value)).otherwise(value)
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    plain = F.coalesce(number.try_cast("double").cast("long"), F.lit(0))
    return F.when(value == "true", F.lit(1)).when(value.rlike(r"^[{\[]"), (~value.isin("[]", "{}")).cast("long")).otherwise(plain)


def _locations(meta: Column) -> Column:
    """``locations`` of the meta if that is a list, else one made of its line and column."""
    whole, line, column = (J.value_of(meta, k) for k in ("locations", "line", "column"))
    place = J.listed(F.array(J.obj(J.members(("line", _as_int(line).cast("string")), ("column", _as_int(column).cast("string"))))))
    is_list = F.coalesce(whole.rlike(r"^[{\[]"), F.lit(False))
    return F.when(is_list, F.when(~whole.isin("[]", "{}"), whole)).when(line.isNotNull() & column.isNotNull(), place)


def render_graphql(err: DataFrame, cfg: C.RenderConfig = C.RenderConfig()) -> DataFrame:
    """GraphQL: locations and path are lifted out of the meta, which wins over code, category and the like in ``extensions``."""
    f = _fields(err, cfg)
    meta = F.col("meta")
    path = J.value_of(meta, "path")
    base = [("code", _text(F.col("code"))), ("category", _text(F.col("category"))), ("timestamp", F.col("ts")), ("errorId", F.col("eid"))]
    tail = J.members(("suggestion", F.col("sugg")), ("documentation", F.col("link")), ("debug", F.col("debug")))
    extensions = J.obj(RD.let(J.merged(J.members(*base), J.without(meta, C.GRAPHQL_LIFTED)), lambda m: J.merged(m, tail)))
    one = J.obj(J.members(
        ("message", F.col("msg")), ("locations", _locations(meta)),
        ("path", F.when(path.rlike(r"^[{\[]") & ~path.isin("[]", "{}"), path)), ("extensions", extensions),
    ))

    def each(field: Column, message: Column, raw: Column) -> Column:
        more = J.members(*base, ("field", _text(field)), ("validation", F.lit("true")), ("debug", F.col("debug")))
        return J.obj(J.members(("message", _text(message)), ("extensions", J.obj(more))))

    errors = F.when(F.col("invalid"), _each_message(each, cfg)).otherwise(J.listed(F.array(one)))
    return f.select("id", "http_status", F.concat(F.lit('{"errors":'), errors, F.lit(',"data":null}')).alias("body"))


for _name, _fn in (("jsend", render_jsend), ("rfc7807", render_problem), ("jsonapi", render_jsonapi), ("graphql", render_graphql)):
    register_renderer(_name, _fn)


# ---- validation fan-out and summaries -------------------------------------------


def validation_fanout(v: DataFrame) -> DataFrame:
    """field -> messages maps to one JSON:API-style error row per message."""
    x = v.select("id", F.explode("errors").alias("field", "messages"))
    y = x.select("id", "field", F.posexplode("messages").alias("pos0", "message"))
    return y.select(
        "id",
        "field",
        (F.col("pos0") + 1).alias("pos"),
        F.lit(str(C.STATUS_VALIDATION)).alias("status"),
        CL.validation_code(F.col("message")).alias("code"),
        F.lit(C.VALIDATION_ITEM_TITLE).alias("title"),
        F.col("message").alias("detail"),
        CL.json_pointer(F.col("field")).alias("pointer"),
    )


def validation_summary(v: DataFrame, cfg: C.RenderConfig = C.RenderConfig()) -> DataFrame:
    """Per field: first message (PII redacted, default 'Validation failed') and its code, or the message alone
    when codes are switched off."""

    def one(k: Column, messages: Column) -> Column:
        first = F.get(messages, F.lit(0))
        text = RD.redact(F.coalesce(first, F.lit(C.VALIDATION_MESSAGE)), cfg.redaction.pii_redaction)
        if not cfg.include_error_codes:
            return text
        code = CL.validation_code(F.coalesce(RD.redact(first, cfg.redaction.pii_redaction), F.lit("")))
        return F.struct(text.alias("message"), code.alias("code"))

    return v.select("id", F.transform_values("errors", one).alias("summary"))


def trace_head(trace: Column, n: int = 10, cfg: C.RedactionConfig = C.RedactionConfig()) -> Column:
    """First ``n`` frames with defaults for missing fields and masked args."""
    return F.transform(
        F.slice(trace, 1, n),
        lambda fr: F.struct(
            F.coalesce(fr.getField("file"), F.lit("unknown")).alias("file"),
            F.coalesce(fr.getField("line"), F.lit(0)).alias("line"),
            F.coalesce(fr.getField("function"), F.lit("unknown")).alias("function"),
            fr.getField("class").alias("class"),
            fr.getField("type").alias("type"),
            F.transform(fr.getField("args"), lambda a: RD.mask_secrets(a, cfg.mask_sensitive_data)).alias("args"),
        ),
    )


def assemble_error_records(err: DataFrame, cfg: C.RenderConfig = C.RenderConfig()) -> DataFrame:
    """The record that is stored of an error, as it came: (id, error_id, exception_class, error_code, message,
    status_code, context, meta).

    Code and message are kept raw (masking is the reader's part), the status is
    normalised.  context (JSON text) is file, line and the first frames of the
    trace, these only with ``include_debug``, overlaid by the error's own
    context; meta (JSON text) is the error's own with its suggestions and links.
    Columns that the table lacks count as null.
    """
    e = _with_optional(err)
    frames = F.coalesce(F.to_json(F.transform(F.slice("trace", 1, 10), _stored_frame), {"ignoreNullFields": "false"}), F.lit("[]"))
    base = J.members(
        ("file", _text(F.col("file"))), ("line", F.col("line").cast("string")), ("trace", frames if cfg.include_debug else F.lit("[]")),
    )
    more = J.members(("suggestions", F.to_json("suggestions")), ("links", F.col("links")))
    return e.select(
        "id", "error_id", "exception_class", "error_code", "message",
        CL.normalised_status(F.col("status_code")).alias("status_code"),
        J.obj(J.merged(base, J.entries(F.col("context")))).alias("context"),
        J.obj(J.merged(J.entries(F.col("meta")), more)).alias("meta"),
    )


def _stored_frame(fr: Column) -> Column:
    return F.struct(
        F.coalesce(fr.getField("file"), F.lit("unknown")).alias("file"), F.coalesce(fr.getField("line"), F.lit(0)).alias("line"),
        F.coalesce(fr.getField("function"), F.lit("unknown")).alias("function"), fr.getField("class").alias("class"),
        fr.getField("type").alias("type"),
    )
