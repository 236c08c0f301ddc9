"""Time-bucketed trends (A7, A8, A10, A11), trend direction and bars
(W1, W2, W5, T5).

Bucketing is a ``groupBy`` on a label expression: partial counts are taken
per map task, so a hot bucket costs one row per task in the shuffle.  The
ordered windows (W1, W2, W5) run only over the aggregated buckets - one row
per period, never per error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import filters as P

INTERVALS = ("minute", "hour", "day", "week", "month")


def period_label(ts: Column, interval: str) -> Column:
    P.check_choice(interval, set(INTERVALS))
    if interval == "hour":
        return F.date_format(ts, "yyyy-MM-dd HH:00:00")
    if interval == "minute":
        return F.date_format(ts, "yyyy-MM-dd HH:mm:00")
    if interval == "month":
        return F.date_format(ts, "yyyy-MM")
    if interval == "week":
        # ISO week-year and week number, e.g. 2024-05
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM-dd")


def trend(err: DataFrame, as_of, days: int = 7, interval: str = "day") -> DataFrame:
    """Error counts per period, ascending; empty periods are absent."""
    P.check_days(days)
    w = P.since_days(err, as_of, days)
    g = w.groupBy(period_label(F.col("created_at"), interval).alias("period")).agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy("period")


def auto_interval(days: int) -> str:
    return "hour" if days <= 1 else "day"


def error_rate_series(err: DataFrame, as_of, days: int = 1, interval: str | None = None) -> DataFrame:
    P.check_days(days)
    return trend(err, as_of, days, interval or auto_interval(days))


def granularity_for(period: str) -> str:
    """Period choice of the analytics page: 1h/24h hourly, 7d/30d daily, else weekly."""
    return {"1h": "hour", "24h": "hour", "7d": "day", "30d": "day"}.get(period, "week")


def _ranked(buckets: DataFrame) -> DataFrame:
    # buckets has one row per period: a global window over it is tiny
    return buckets.withColumn("rank_desc", F.row_number().over(Window.orderBy(F.col("period").desc())))


def trend_direction(buckets: DataFrame) -> DataFrame:
    """Mean of the last 3 buckets against the 3 before.

    Returns one row when there are at least 2 buckets and the previous mean is
    positive, else no row.  With fewer than 6 buckets the previous slice is
    the ranks 4-6 that exist.
    """
    r = _ranked(buckets)
    agg = r.agg(
        F.count(F.lit(1)).alias("buckets"),
        F.avg(F.when(F.col("rank_desc") <= 3, F.col("count"))).alias("recent_avg"),
        F.avg(F.when(F.col("rank_desc").between(4, 6), F.col("count"))).alias("previous_avg"),
    )
    change = (F.col("recent_avg") - F.col("previous_avg")) / F.col("previous_avg") * 100.0
    return agg.filter((F.col("buckets") >= 2) & (F.col("previous_avg") > 0)).select(
        F.round("recent_avg", 4).alias("recent_avg"),
        F.round("previous_avg", 4).alias("previous_avg"),
        F.round(change, 1).alias("change_pct"),
        F.when(change > 0, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
    )


def trend_last(buckets: DataFrame, n: int = 7) -> DataFrame:
    return _ranked(buckets).filter(F.col("rank_desc") <= n).select("period", "count").orderBy("period")


def trend_first(buckets: DataFrame, n: int = 5) -> DataFrame:
    return buckets.orderBy("period").limit(n)


def bar(value: Column, max_value: Column, width: int) -> Column:
    filled = F.round(value / max_value * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def trend_bars(buckets: DataFrame, width: int = 20) -> DataFrame:
    """Last 7 buckets with a bar scaled to the largest count of all buckets."""
    mx = F.max("count").over(Window.partitionBy())
    r = _ranked(buckets).withColumn("max_count", mx)
    return r.filter(F.col("rank_desc") <= 7).select(
        "period",
        "count",
        F.round(F.col("count") / F.col("max_count") * width).cast("int").alias("filled"),
        bar(F.col("count"), F.col("max_count"), width).alias("bar"),
    )


def share_bars(dist: DataFrame, width: int = 30) -> DataFrame:
    """Percentage bars (out of 100) for a status distribution."""
    return dist.select(
        "status_code",
        "count",
        "percentage",
        F.round(F.col("percentage") / 100.0 * width).cast("int").alias("filled"),
        bar(F.col("percentage"), F.lit(100.0), width).alias("bar"),
    )


def daily_trends(err: DataFrame, count_mode: str = "first") -> DataFrame:
    """Daily trend table: count per (date, error_code, status_code) and a
    24-slot hourly histogram.

    ``count_mode='first'`` counts only the first sighting of each error_id
    (later repeats only bump the error row); ``'occurrences'`` counts every row.
    The first sighting is a ``min_by`` aggregate per error_id - partial per
    map task, so a hot error_id never lands whole in one task.
    """
    P.check_choice(count_mode, {"first", "occurrences"})
    if count_mode == "first":
        firsts = err.groupBy("error_id").agg(
            F.min_by(F.struct("created_at", "error_code", "status_code"), F.struct("created_at", "id")).alias("f")
        )
        rows = firsts.select("f.created_at", "f.error_code", "f.status_code")
    else:
        rows = err.select("created_at", "error_code", "status_code")
    hour = F.hour("created_at")
    slots = [F.count_if(hour == h).cast("int") for h in range(24)]
    return rows.groupBy(F.to_date("created_at").alias("date"), "error_code", "status_code").agg(
        F.count(F.lit(1)).alias("count"), F.array(*slots).alias("hourly_distribution")
    )


def trend_rows(trends: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Trend rows whose date is on or after the window start's date."""
    start = F.to_date(P.days_before(as_of, days))
    return trends.filter(F.col("date") >= start).orderBy("date", F.col("error_code").asc_nulls_first(), "status_code")
