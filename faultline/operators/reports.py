"""Combined reports.

Each report part is aggregated to a bounded size first (one KPI row, top-k
rows, one row per status code or per day) and only then folded into one
JSON document, so nothing unbounded is collected into a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline import config as C
from faultline.operators import aggregates as AG
from faultline.operators import topk as TK
from faultline.operators import trends as TR


def catalogue(spark: SparkSession) -> DataFrame:
    """The fixed 7-row error catalogue (code, status, title, description, example)."""
    return spark.createDataFrame(
        list(C.ERROR_CATALOGUE), "code string, status int, title string, description string, example string"
    )


def error_catalogue_coverage(spark: SparkSession, err: DataFrame) -> DataFrame:
    """Catalogue rows with how many errors carry each status.

    The catalogue has a fixed 7 rows, so broadcasting it is size-safe; the
    errors side is pre-aggregated to one row per status before the join.
    """
    per_status = err.groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))
    cat = F.broadcast(catalogue(spark))
    j = cat.join(per_status, cat["status"] == per_status["status_code"], "left")
    return j.select("code", "status", "title", "description", "example", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("errors"))


def doc_stats(err: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Documentation numbers: four KPIs over ``days`` and the top 5 of the
    top-10 error rows, as (section, ordinal, label, value) rows."""
    k = AG.analytics_kpis(err, as_of, days)
    stats = k.select(
        F.expr(
            "stack(4, 1, 'Total Errors', total_errors, 2, 'Unique Errors', unique_errors,"
            " 3, 'Unresolved', unresolved_errors, 4, 'Resolved', resolved_errors) AS (ordinal, label, value)"
        )
    ).select(F.lit("stats").alias("section"), "ordinal", "label", F.col("value").cast("bigint").alias("value"))
    top = TK.top_errors(err, as_of, 10, days)
    w = Window.orderBy(F.col("count").desc(), F.col("id").desc())
    ranked = top.select(F.row_number().over(w).alias("ordinal"), F.col("message").alias("label"), F.col("count").cast("bigint").alias("value"))
    top5 = ranked.filter(F.col("ordinal") <= 5).select(F.lit("top_errors").alias("section"), "ordinal", "label", "value")
    return stats.unionByName(top5)


def _one_row_list(df: DataFrame, name: str, order_cols) -> DataFrame:
    """Fold an already-bounded frame into one row holding a sorted array."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*order_cols, *[c for c in df.columns if c not in order_cols]))).alias(name))


def analysis_report(err: DataFrame, as_of, days: int = 7, top_limit: int = 10) -> DataFrame:
    """Period, KPIs, top errors, status distribution and daily trend as one JSON row."""
    kpis = AG.analytics_kpis(err, as_of, days).select(F.struct("*").alias("analytics"))
    ranked = TK.top_errors(err, as_of, top_limit, days).withColumn("neg", -F.col("count")).withColumn("nid", -F.col("id"))
    top = _one_row_list(ranked, "top_errors", ["neg", "nid"])
    dist = _one_row_list(AG.status_distribution(err, as_of, days), "distribution", ["status_code"])
    trend = _one_row_list(TR.trend(err, as_of, days, "day"), "trends", ["period"])
    # every part is a single-row aggregate: put them side by side
    j = AG.one_row(kpis, top, dist, trend)
    body = F.struct(
        F.lit(f"{days} days").alias("period"),
        F.col("analytics"),
        F.transform("top_errors", lambda s: s.dropFields("neg", "nid")).alias("top_errors"),
        F.col("distribution"),
        F.col("trends"),
    )
    return j.select(F.to_json(body).alias("report"))


def stats_report(err: DataFrame, cb: DataFrame, as_of, days: int = 7) -> DataFrame:
    kpis = AG.analytics_kpis(err, as_of, days).select(F.struct("*").alias("errors"))
    b = AG.breaker_stats(cb, as_of).select(F.struct("*").alias("circuit_breakers"))
    j = AG.one_row(kpis, b)
    return j.select(F.to_json(F.struct(F.lit(days).alias("period_days"), "errors", "circuit_breakers")).alias("report"))
