"""KPI and group-by aggregations.

KPI sets the reference computes with several separate statements are fused
into one ``agg`` per scan: one partial aggregation per map task, one tiny
final aggregation.  Count-distincts can switch to HyperLogLog
(``approx=True``) so large scans avoid the Expand + distinct shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import config as C
from faultline.operators import filters as P


def one_row(*frames: DataFrame) -> DataFrame:
    """Put the columns of several single-row aggregates side by side without a
    join: union them (missing columns null) and take each column's non-null
    value in one tiny aggregation."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def _distinct(col: str, approx: bool) -> Column:
    return F.approx_count_distinct(col) if approx else F.count_distinct(F.col(col))


def rate(part: Column, total: Column, digits: int = 1) -> Column:
    """``round(100 * part / total, digits)`` as double, 0 when total is 0."""
    return F.when(total > 0, F.round(F.lit(100.0) * part / total, digits)).otherwise(F.lit(0.0)).cast("double")


def kpi_columns(days: int, approx: bool = False) -> list[Column]:
    total = F.count(F.lit(1))
    resolved = F.count_if(F.col("is_resolved"))
    return [
        total.alias("total_errors"),
        _distinct("error_id", approx).alias("unique_errors"),
        F.count_if(~F.col("is_resolved")).alias("unresolved_errors"),
        resolved.alias("resolved_errors"),
        rate(resolved, total).alias("resolution_rate"),
        F.round(total / F.lit(float(days)), 2).alias("avg_errors_per_day"),
        _distinct("user_id", approx).alias("affected_users"),
        F.round(F.avg("response_ms"), 2).alias("avg_response_time"),
    ]


def analytics_kpis(err: DataFrame, as_of, days: int = C.ANALYTICS_DAYS_DEFAULT, approx: bool = False) -> DataFrame:
    """Total, unique, unresolved, resolved, resolution rate, average per day,
    affected users and average response time in one pass."""
    days = P.check_days(days)
    return P.since_days(err, as_of, days).agg(*kpi_columns(days, approx))


def affected_users(err: DataFrame, as_of, days: int = 7, approx: bool = False) -> DataFrame:
    return P.since_days(err, as_of, days).agg(_distinct("user_id", approx).alias("affected_users"))


def avg_response_time(err: DataFrame, as_of, days: int = 7) -> DataFrame:
    return P.since_days(err, as_of, days).agg(F.round(F.avg("response_ms"), 2).alias("avg_response_time"))


def top_error_groups(err: DataFrame, as_of, days: int = 7, limit: int = 10) -> DataFrame:
    """Count by (error_code, message), most frequent first (TakeOrderedAndProject)."""
    P.check_days(days)
    P.check_limit(limit)
    g = P.since_days(err, as_of, days).groupBy("error_code", "message").agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.col("count").desc(), F.col("error_code").asc_nulls_first(), F.col("message")).limit(limit)


def errors_by_status(err: DataFrame, as_of, days: int = 7) -> DataFrame:
    P.check_days(days)
    g = P.since_days(err, as_of, days).groupBy("status_code").agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.col("count").desc(), "status_code")


def status_distribution(err: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Status counts with their share of the total, 2 dp.

    The share is a window over the *aggregated* rows (one per status code),
    so the single-partition window only ever sees a few hundred rows.
    """
    P.check_days(days)
    g = P.since_days(err, as_of, days).groupBy("status_code").agg(F.count(F.lit(1)).alias("count"))
    share = F.round(F.lit(100.0) * F.col("count") / F.sum("count").over(Window.partitionBy()), 2)
    return g.select("status_code", "count", share.cast("double").alias("percentage")).orderBy(
        F.col("count").desc(), "status_code"
    )


def error_stats(err: DataFrame, as_of) -> DataFrame:
    """total / unresolved / resolved / today / this week / this month."""
    t = P._ts(as_of)
    day0 = F.to_date(t)
    week0 = F.date_trunc("week", t).cast("timestamp_ntz")
    month0 = F.date_trunc("month", t).cast("timestamp_ntz")
    return err.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_resolved")).alias("unresolved"),
        F.count_if(F.col("is_resolved")).alias("resolved"),
        F.count_if(F.to_date("created_at") == day0).alias("today"),
        F.count_if(F.col("created_at") >= week0).alias("this_week"),
        F.count_if(F.col("created_at") >= month0).alias("this_month"),
    )


def list_summary(err: DataFrame, filters: dict | None = None) -> DataFrame:
    """Total / resolved / unresolved plus the most common status code
    (ties go to the lowest code)."""
    f = P.apply_filters(err, filters)
    by_status = f.groupBy("status_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolved_at").isNotNull()).alias("r")
    )
    # one row per status code, folded into the summary row
    s = by_status.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("resolved"),
        F.max_by("status_code", F.struct(F.col("n"), -F.col("status_code"))).alias("top_status_code"),
    )
    return s.select("total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"), "top_status_code")


def breaker_stats(cb: DataFrame, as_of) -> DataFrame:
    return cb.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "open").alias("open"),
        F.count_if(F.col("state") == "half_open").alias("half_open"),
        F.count_if(F.col("state") == "closed").alias("closed"),
        F.count_if(F.col("last_failure_at") >= P.hours_before(as_of, 1)).alias("recent_failures"),
    )


def breaker_health(cb: DataFrame) -> DataFrame:
    c = cb.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "closed").alias("healthy"),
        F.count_if(F.col("state") == "open").alias("open"),
        F.count_if(F.col("state") == "half_open").alias("half_open"),
    )
    return c.select(
        (F.col("open") == 0).alias("is_healthy"),
        F.when(F.col("open") == 0, F.lit("All circuit breakers closed"))
        .otherwise(F.concat(F.col("open").cast("string"), F.lit(" circuit breaker(s) open")))
        .alias("message"),
        "total",
        "healthy",
        "open",
        "half_open",
    )


def breaker_health_strict(cb: DataFrame) -> DataFrame:
    c = cb.agg(F.count_if(F.col("state") == "closed").alias("healthy_breakers"), F.count(F.lit(1)).alias("total_breakers"))
    return c.select(
        F.when(F.col("healthy_breakers") == F.col("total_breakers"), F.lit("healthy")).otherwise(F.lit("degraded")).alias("status"),
        "healthy_breakers",
        "total_breakers",
    )


def health_checks(err: DataFrame, cb: DataFrame) -> DataFrame:
    """One row per check: the errors table answers a scan, and no breaker is open."""
    errors_ok = err.agg(F.lit("errors_table").alias("check"), (F.count(F.lit(1)) >= 0).alias("healthy"))
    breakers_ok = cb.agg(F.lit("circuit_breakers").alias("check"), (F.count_if(F.col("state") == "open") == 0).alias("healthy"))
    return errors_ok.unionByName(breakers_ok)


def system_health(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.when(F.bool_and("healthy"), F.lit("healthy")).otherwise(F.lit("degraded")).alias("status"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("healthy")).alias("failing"),
    )


def health_class(err: DataFrame, cb: DataFrame, as_of, days: int = 7) -> DataFrame:
    """EXCELLENT / GOOD / WARNING / CRITICAL from unresolved errors and open breakers."""
    u = P.since_days(err, as_of, days).agg(F.count_if(~F.col("is_resolved")).alias("unresolved"))
    o = cb.agg(F.count_if(F.col("state") == "open").alias("open_breakers"))
    j = one_row(u, o)
    uu, oo = F.col("unresolved"), F.col("open_breakers")
    cls = (
        F.when((uu == 0) & (oo == 0), "EXCELLENT")
        .when((uu <= 5) & (oo == 0), "GOOD")
        .when((uu <= 10) | (oo <= 2), "WARNING")
        .otherwise("CRITICAL")
    )
    return j.select("unresolved", "open_breakers", cls.alias("health"))


def recommendations(err: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Advice rules over the KPI row and the most frequent error group."""
    w = P.since_days(err, as_of, days)
    k = w.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_resolved")).alias("unresolved"),
        F.count_if(F.col("is_resolved")).alias("resolved"),
    )
    top = top_error_groups(err, as_of, days, 1).select(F.col("count").alias("top_count"), F.col("message").alias("top_message"))
    j = one_row(k, top)
    res_rate = F.when(F.col("total") > 0, F.col("resolved") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    rules = F.array(
        F.when(F.col("unresolved") > 10, F.lit("unresolved_attention")),
        F.when(F.coalesce(F.col("top_count"), F.lit(0)) > 5, F.lit("investigate_top_error")),
        F.when(res_rate < 50, F.lit("low_resolution_rate")),
        F.when((F.col("unresolved") == 0) & (F.col("total") > 0), F.lit("all_resolved")),
    )
    return j.select(F.explode(F.array_compact(rules)).alias("recommendation"))


def retention_count(err: DataFrame, as_of, days: int = C.RETENTION_DAYS, status: str = "all") -> DataFrame:
    return P.retention_candidates(err, as_of, days, status).agg(F.count(F.lit(1)).alias("count"))


def peak_hour(err: DataFrame, as_of, days: int = 7) -> DataFrame:
    g = P.since_days(err, as_of, days).groupBy(F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.col("count").desc(), "hour").limit(1)


def error_rate_pct(calls: DataFrame) -> DataFrame:
    """Failed calls as a percentage of all calls, 2 dp."""
    return calls.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("failed"),
    ).select("calls", "failed", rate(F.col("failed"), F.col("calls"), 2).alias("error_rate"))
