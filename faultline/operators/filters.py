"""Row predicates over the errors and breakers tables.

Predicates compare bare columns against literals (``created_at >= lit``) so
the parquet reader receives them as pushed filters and date partitions prune.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import config as C


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, date):
        value = value.strftime("%Y-%m-%d") + " 00:00:00"
    elif isinstance(value, str) and len(value) == 10:
        value = value + " 00:00:00"  # a bare date means midnight
    return F.lit(value).cast("timestamp_ntz")


def hours_before(as_of, hours: int) -> Column:
    return _ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(int(hours)))


def days_before(as_of, days: int) -> Column:
    return _ts(as_of) - F.make_dt_interval(F.lit(int(days)))


# ---- validation (driver side, before any plan is built) -------------------


def check_days(days: int) -> int:
    if not 1 <= int(days) <= 365:
        raise ValueError("Days must be between 1 and 365")
    return int(days)


def check_per_page(per_page: int) -> int:
    if not 1 <= int(per_page) <= C.PAGE_SIZE_MAX:
        raise ValueError("Per page must be between 1 and 100")
    return int(per_page)


def check_limit(limit: int) -> int:
    if not 1 <= int(limit) <= 100:
        raise ValueError("Limit must be between 1 and 100")
    return int(limit)


def check_choice(value: str, allowed) -> str:
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of {sorted(allowed)}")
    return value


def check_range(date_from, date_to) -> None:
    if date_from is not None and date_to is not None and str(date_to) < str(date_from):
        raise ValueError("to must be on or after from")


# ---- error predicates -------------------------------------------------------


def unresolved(err: DataFrame) -> DataFrame:
    return err.filter(~F.col("is_resolved"))


def resolved(err: DataFrame) -> DataFrame:
    return err.filter(F.col("is_resolved"))


def by_status_code(err: DataFrame, status_code: int) -> DataFrame:
    return err.filter(F.col("status_code") == int(status_code))


def by_error_code(err: DataFrame, error_code: str) -> DataFrame:
    return err.filter(F.col("error_code") == error_code)


def recent(err: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return err.filter(F.col("created_at") >= hours_before(as_of, hours))


def since_days(err: DataFrame, as_of, days: int = C.ANALYTICS_DAYS_DEFAULT) -> DataFrame:
    return err.filter(F.col("created_at") >= days_before(as_of, days))


def search_predicate(text: str) -> Column:
    """Literal, case-insensitive substring match over message, url and code."""
    needle = F.lit(text.lower())
    cols = ("message", "request_url", "error_code")
    preds = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, preds)


def search(err: DataFrame, text: str) -> DataFrame:
    return err.filter(search_predicate(text))


def date_range(err: DataFrame, date_from=None, date_to=None) -> DataFrame:
    check_range(date_from, date_to)
    out = err
    if date_from is not None:
        out = out.filter(F.col("created_at") >= _ts(date_from))
    if date_to is not None:
        out = out.filter(F.col("created_at") <= _ts(date_to))
    return out


def apply_filters(err: DataFrame, filters: dict | None = None) -> DataFrame:
    """AND of the optional list filters; falsy values are dropped."""
    f = {k: v for k, v in (filters or {}).items() if v not in (None, "", 0, False)}
    out = err
    status = f.get("status")
    if status == "resolved":
        out = resolved(out)
    elif status == "unresolved":
        out = unresolved(out)
    if "status_code" in f:
        out = by_status_code(out, int(f["status_code"]))
    if "search" in f:
        out = search(out, str(f["search"]))
    if "from_date" in f or "to_date" in f:
        out = date_range(out, f.get("from_date"), f.get("to_date"))
    return out


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc())


def page(err: DataFrame, filters: dict | None = None, page_no: int = 1, per_page: int = C.PAGE_SIZE_DEFAULT) -> DataFrame:
    """Page ``page_no`` of the filtered list, newest first (top-k per page)."""
    per_page = check_per_page(per_page)
    if page_no < 1:
        raise ValueError("page must be >= 1")
    ordered = newest_first(apply_filters(err, filters))
    return ordered.offset((page_no - 1) * per_page).limit(per_page)


def page_after(err: DataFrame, last_created_at, last_id: int, filters: dict | None = None, per_page: int = C.PAGE_SIZE_DEFAULT) -> DataFrame:
    """Keyset page: rows strictly after ``(last_created_at, last_id)`` in
    newest-first order.  Deep pages cost the same as the first one."""
    per_page = check_per_page(per_page)
    t = _ts(last_created_at)
    after = (F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("id") < int(last_id)))
    return newest_first(apply_filters(err, filters).filter(after)).limit(per_page)


def page_total(err: DataFrame, filters: dict | None = None) -> DataFrame:
    return apply_filters(err, filters).agg(F.count(F.lit(1)).alias("total"))


def by_id(df: DataFrame, ident) -> DataFrame:
    return df.filter(F.col("id") == F.lit(ident))


def require_one(df: DataFrame, what: str = "row") -> DataFrame:
    """Raise ``LookupError`` when ``df`` is empty (a one-row probe)."""
    if not df.take(1):
        raise LookupError(f"{what} not found")
    return df


def by_id_or_fail(df: DataFrame, ident, what: str = "row") -> DataFrame:
    """The row with the id; ``LookupError`` if there is none."""
    return require_one(by_id(df, ident), f"{what} {ident}")


def by_ids(df: DataFrame, ids) -> DataFrame:
    """Rows whose id is in ``ids``: a list literal or a DataFrame of ``id``.

    A DataFrame of ids becomes a left-semi join, so the id set has no size
    cap; Catalyst broadcasts it only when its statistics are small.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select("id").distinct(), on="id", how="left_semi")
    return df.filter(F.col("id").isin(list(ids)))


def retention_candidates(err: DataFrame, as_of, days: int = C.RETENTION_DAYS, status: str = "all") -> DataFrame:
    check_choice(status, {"all", "resolved"})
    out = err.filter(F.col("created_at") < days_before(as_of, days))
    if status == "resolved":
        out = out.filter(F.col("resolved_at").isNotNull())
    return out


def critical(err: DataFrame, codes=C.CRITICAL_STATUS) -> DataFrame:
    return err.filter(F.col("status_code").isin(list(codes)))


def critical_recent_unresolved(err: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Unresolved server errors of the last ``hours``, newest first."""
    return newest_first(unresolved(recent(err.filter(F.col("status_code") >= 500), as_of, hours)))


def recoverable_request(method: Column, message: Column, status: Column) -> Column:
    msg = F.lower(message)
    words = reduce(lambda a, b: a | b, [msg.contains(w) for w in ("timeout", "connection", "rate_limit")])
    return method.isin("GET", "HEAD") & (words | status.isin(429, 502, 503, 504))


def recoverable_requests(err: DataFrame) -> DataFrame:
    return err.filter(recoverable_request(F.col("request_method"), F.col("message"), F.col("status_code")))


# ---- breaker predicates -----------------------------------------------------


def breakers_filtered(cb: DataFrame, state: str | None = None, service: str | None = None) -> DataFrame:
    out = cb
    if state:
        out = out.filter(F.col("state") == state)
    if service:
        out = out.filter(F.col("service").contains(service))
    return out.orderBy(F.col("updated_at").desc(), F.col("id").desc())


def breakers_to_reset(cb: DataFrame, ident=None, service: str | None = None, state: str | None = None) -> DataFrame:
    out = cb
    if ident is not None:
        out = out.filter(F.col("id") == F.lit(ident))
    if service is not None:
        out = out.filter(F.col("service") == service)
    if state is not None:
        out = out.filter(F.col("state") == state)
    return out


def breakers_unhealthy(cb: DataFrame, as_of) -> DataFrame:
    """The breakers that are not closed, and whether they would let a call through now."""
    from faultline.functions.classify import can_attempt

    attempt = can_attempt(F.col("state"), F.col("next_attempt_at"), _ts(as_of))
    return cb.filter(F.col("state") != "closed").select(
        "service", "operation", "state", "failure_count", "next_attempt_at", attempt.alias("can_attempt")
    )


def breakers_stuck_open(cb: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    cutoff = _ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes)))
    return cb.filter((F.col("state") == "open") & (F.col("opened_at") < cutoff))
