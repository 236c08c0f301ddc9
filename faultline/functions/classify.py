"""Classification column functions.

Each returns a ``Column`` built from ``when`` chains, literal maps and
``rlike`` - no Python UDFs, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import config as C


def _lit_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def status_severity(status: Column) -> Column:
    return F.when(status >= 500, F.lit("red")).when(status >= 400, F.lit("yellow")).otherwise(F.lit("green"))


def jsend_status(status: Column) -> Column:
    return F.when(status >= 500, F.lit("error")).when(status >= 400, F.lit("fail")).otherwise(F.lit("success"))


def status_title(status: Column) -> Column:
    return F.coalesce(F.try_element_at(_lit_map(C.STATUS_TITLES), status), F.lit("Error"))


def problem_type_uri(code: Column, prefix: str = C.PROBLEM_TYPE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.lower(F.replace(code, F.lit("_"), F.lit("-"))))


def class_basename(cls: Column) -> Column:
    return F.substring_index(cls, "\\", -1)


def derived_error_code(exception_class: Column) -> Column:
    """Class basename without ``Exception``, in snake_case."""
    base = F.replace(class_basename(exception_class), F.lit("Exception"), F.lit(""))
    return F.lower(F.regexp_replace(base, r"(.)(?=[A-Z])", "$1_"))


def error_category(status: Column, exception_class: Column | None = None) -> Column:
    chain = F.when(status == 401, "authentication")
    if exception_class is not None:
        chain = F.when(class_basename(exception_class) == C.VALIDATION_EXCEPTION, "validation").when(status == 401, "authentication")
    return (
        chain.when(status == 403, "authorization")
        .when(status == 404, "not_found")
        .when(status == 429, "rate_limit")
        .when(status >= 500, "internal")
        .when(status >= 400, "client")
        .otherwise("unknown")
    )


def category_list(status: Column, categories=C.CATEGORIES) -> Column:
    """Every configured category containing ``status`` (categories overlap)."""
    return F.array_compact(F.array(*[F.when(status.isin(list(codes)), F.lit(name)) for name, codes in categories]))


def validation_code(message: Column) -> Column:
    chain = None
    for word, code in C.VALIDATION_CODES:
        cond = message.contains(word)
        chain = F.when(cond, F.lit(code)) if chain is None else chain.when(cond, F.lit(code))
    return chain.otherwise(F.lit(C.VALIDATION_DEFAULT_CODE))


def json_pointer(field: Column) -> Column:
    return F.concat(F.lit("/data/attributes/"), F.replace(field, F.lit("."), F.lit("/")))


#: Digits have no case, so one expression serves words and numbers alike.
TRANSIENT_REGEX = "(?i)(" + "|".join(C.TRANSIENT_PATTERNS) + ")"


def is_transient(message: Column, status: Column) -> Column:
    """Message matches a transient pattern, or status is a transient code."""
    return F.coalesce(
        message.rlike(TRANSIENT_REGEX) | status.isin(list(C.TRANSIENT_STATUS)),
        F.lit(False),
    )


def suggestion_type(message: Column) -> Column:
    low = F.lower(message)
    chain = None
    for key, _, _ in C.SUGGESTIONS:
        cond = low.contains(key)
        chain = F.when(cond, F.lit(key)) if chain is None else chain.when(cond, F.lit(key))
    return chain.otherwise(F.lit(C.GENERAL_SUGGESTION[0]))


def _all_suggestions():
    return tuple(C.SUGGESTIONS) + (C.GENERAL_SUGGESTION, C.NON_RECOVERABLE_SUGGESTION)


def recovery_suggestion(message: Column, recoverable: Column | None = None) -> Column:
    """struct(type, message, actions) - the first keyword wins; non-recoverable
    errors get the fixed non-recoverable advice."""
    kind = suggestion_type(message)
    if recoverable is not None:
        kind = F.when(recoverable, kind).otherwise(F.lit(C.NON_RECOVERABLE_SUGGESTION[0]))
    texts = _lit_map([(k, m) for k, m, _ in _all_suggestions()])
    actions = F.create_map(*[x for k, _, a in _all_suggestions() for x in (F.lit(k), F.array(*[F.lit(s) for s in a]))])
    return F.struct(
        kind.alias("type"),
        F.element_at(texts, kind).alias("message"),
        F.element_at(actions, kind).alias("actions"),
    )


def can_attempt(state: Column, next_attempt_at: Column, as_of: Column) -> Column:
    """closed, half_open, or open with the next attempt strictly in the past."""
    return F.coalesce(
        state.isin("closed", "half_open") | ((state == "open") & (next_attempt_at < as_of)),
        F.lit(False),
    )


def is_open(state: Column, next_attempt_at: Column, as_of: Column) -> Column:
    return F.coalesce((state == "open") & (next_attempt_at > as_of), F.lit(False))


def retry_after(state: Column, next_attempt_at: Column, as_of: Column) -> Column:
    from faultline.functions.formatting import epoch_seconds

    secs = epoch_seconds(next_attempt_at) - epoch_seconds(as_of)
    return F.when(is_open(state, next_attempt_at, as_of), F.greatest(F.lit(0).cast("bigint"), secs))


def breaker_identifier(service: Column, operation: Column) -> Column:
    return F.concat_ws(":", F.lit("circuit_breaker"), service, F.nullif(operation, F.lit("")))


def breaker_progress(failures: Column, threshold: Column) -> Column:
    return F.least(F.round(failures * 100.0 / threshold, 2), F.lit(100.0)).cast("double")


def should_trip(error_code: Column, status: Column) -> Column:
    return F.coalesce(error_code.isin(list(C.CRITICAL_ERROR_CODES)), F.lit(False)) | (status >= 500)


def normalised_status(status: Column) -> Column:
    return F.when(status.between(400, 599), status).otherwise(F.lit(C.STATUS_DEFAULT))


def response_status(status: Column, exception_class: Column) -> Column:
    """The status of a response: validation exceptions always have their own."""
    invalid = class_basename(exception_class) == C.VALIDATION_EXCEPTION
    return F.when(invalid, F.lit(C.STATUS_VALIDATION)).otherwise(normalised_status(status))


def accept_format(accept: Column, default: str = "jsend") -> Column:
    a = F.coalesce(accept, F.lit(""))
    return (
        F.when(a.contains("application/problem+json"), F.lit("rfc7807"))
        .when(a.contains("application/vnd.api+json"), F.lit("jsonapi"))
        .otherwise(F.lit(default))
    )


def is_api_request(accept: Column, path: Column) -> Column:
    a = F.coalesce(accept, F.lit(""))
    return a.contains("json") | F.coalesce(path.startswith("api/"), F.lit(False))

