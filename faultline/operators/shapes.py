"""Row shapes for lists, exports and breaker views.

Pure projections: each is one ``select`` that Catalyst fuses into the scan's
codegen stage, and column pruning reaches the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import formatting as FMT
from faultline.functions.classify import breaker_identifier, can_attempt
from faultline.operators import filters as P


def list_json_rows(err: DataFrame) -> DataFrame:
    return err.select(
        "error_id",
        "message",
        "status_code",
        "occurrence_count",
        F.col("resolved_at").isNotNull().alias("resolved"),
        FMT.iso8601(F.col("updated_at")).alias("last_seen"),
        F.col("request_url").alias("endpoint"),
    )


def list_table_rows(err: DataFrame, as_of) -> DataFrame:
    t = P._ts(as_of)
    return err.select(
        F.concat(F.substring("error_id", 1, 12), F.lit("...")).alias("error_id"),
        FMT.truncate(F.col("message"), 40).alias("message"),
        "status_code",
        "occurrence_count",
        FMT.relative_time(F.col("updated_at"), t).alias("last_seen"),
        F.when(F.col("resolved_at").isNotNull(), F.lit("✓ Resolved")).otherwise(F.lit("Open")).alias("status"),
    )


def list_compact_rows(err: DataFrame, as_of) -> DataFrame:
    t = P._ts(as_of)
    icon = F.when(F.col("resolved_at").isNotNull(), F.lit("✓")).otherwise(F.lit("✗"))
    line = F.format_string(
        "%s [%d] %s (×%d) - %s",
        icon,
        F.col("status_code"),
        FMT.truncate(F.col("message"), 60),
        F.col("occurrence_count"),
        FMT.relative_time(F.col("updated_at"), t),
    )
    return err.select("id", line.alias("line"))


def breaker_json_rows(cb: DataFrame) -> DataFrame:
    return cb.select(
        "id",
        breaker_identifier(F.col("service"), F.col("operation")).alias("identifier"),
        "service",
        "state",
        "failure_count",
        "failure_threshold",
        "success_threshold",
        FMT.iso8601(F.col("last_failure_at")).alias("last_failure_at"),
        FMT.iso8601(F.col("next_attempt_at")).alias("next_attempt_at"),
    )


def breaker_table_rows(cb: DataFrame, as_of) -> DataFrame:
    t = P._ts(as_of)
    return cb.select(
        "id",
        F.substring(breaker_identifier(F.col("service"), F.col("operation")), 1, 20).alias("identifier"),
        "service",
        F.upper("state").alias("state"),
        F.format_string("%d/%d", F.col("failure_count"), F.col("failure_threshold")).alias("failures"),
        F.coalesce(FMT.relative_time(F.col("last_failure_at"), t), F.lit("Never")).alias("last_failure"),
        F.coalesce(FMT.relative_time(F.col("next_attempt_at"), t), F.lit("N/A")).alias("next_attempt"),
        F.format_string(
            "%s (%s) - F:%d/%d", F.col("service"), F.col("state"), F.col("failure_count"), F.col("failure_threshold")
        ).alias("compact"),
    )


def breaker_status(cb: DataFrame, as_of) -> DataFrame:
    t = P._ts(as_of)
    return cb.select(
        "service",
        "operation",
        "state",
        "failure_count",
        "failure_threshold",
        can_attempt(F.col("state"), F.col("next_attempt_at"), t).alias("can_attempt"),
        FMT.iso_string(F.col("next_attempt_at")).alias("next_attempt_at"),
    )


# ---- exports -------------------------------------------------------------


def export_errors(err: DataFrame, as_of, days: int = 7) -> DataFrame:
    days = P.check_days(days)
    w = P.since_days(err, as_of, days)
    return w.orderBy(F.col("created_at").desc(), F.col("id").desc()).select(
        "id",
        "error_code",
        "message",
        "status_code",
        "request_url",
        "request_method",
        "occurrence_count",
        FMT.iso8601(F.col("created_at")).alias("created_at"),
        FMT.iso8601(F.col("updated_at")).alias("updated_at"),
        F.col("resolved_at").isNotNull().alias("is_resolved"),
    )


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def export_errors_csv_rows(export: DataFrame) -> DataFrame:
    """The CSV body shape: headed columns, ``Yes``/``No`` flag, blanks for nulls."""
    return export.select(
        F.col("id").alias("ID"),
        _blank(F.col("error_code")).alias("Error Code"),
        _blank(F.col("message")).alias("Message"),
        F.col("status_code").alias("Status Code"),
        _blank(F.col("request_url")).alias("Endpoint"),
        _blank(F.col("request_method")).alias("Method"),
        F.coalesce(F.col("occurrence_count"), F.lit(0)).alias("Occurrences"),
        _blank(F.col("created_at")).alias("First Seen"),
        _blank(F.col("updated_at")).alias("Last Seen"),
        F.when(F.col("is_resolved"), F.lit("Yes")).otherwise(F.lit("No")).alias("Resolved"),
    )


def export_trends_rows(buckets: DataFrame) -> DataFrame:
    return buckets.select(F.col("period").alias("Period"), F.col("count").alias("Error Count"))


def export_analytics_rows(kpis: DataFrame, top_groups: DataFrame) -> DataFrame:
    """(section, ordinal, Metric, Value) long rows: five metrics, then the
    top error groups as (message, occurrences)."""
    metrics = kpis.select(
        F.expr(
            "stack(5, 1, 'Total Errors', CAST(total_errors AS STRING), 2, 'Unique Errors', CAST(unique_errors AS STRING),"
            " 3, 'Resolved Errors', CAST(resolved_errors AS STRING), 4, 'Unresolved Errors', CAST(unresolved_errors AS STRING),"
            " 5, 'Average per Day', CAST(avg_errors_per_day AS STRING)) AS (ordinal, Metric, Value)"
        )
    ).select(F.lit("metrics").alias("section"), "ordinal", "Metric", "Value")
    top = top_groups.select(
        F.lit("top_errors").alias("section"),
        F.row_number()
        .over(Window.orderBy(F.col("count").desc(), F.col("error_code").asc_nulls_first(), F.col("message")))
        .alias("ordinal"),
        F.coalesce(F.col("message"), F.lit("Unknown")).alias("Metric"),
        F.col("count").cast("string").alias("Value"),
    )
    return metrics.unionByName(top)


def cli_export_rows(err: DataFrame, as_of, days: int = 0, status: str | None = None) -> DataFrame:
    """Rows of the command-line export: status and from-date filters;
    ``days=0`` exports everything.  No page cap."""
    f = {}
    if status:
        f["status"] = status
    out = P.apply_filters(err, f)
    if days:
        out = out.filter(F.col("created_at") >= F.to_date(P.days_before(as_of, days)).cast("timestamp_ntz"))
    return P.newest_first(out)


def cli_export_csv_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("error_id").alias("Error ID"),
        F.col("message").alias("Message"),
        F.col("status_code").alias("Status Code"),
        F.col("request_method").alias("Method"),
        F.col("request_url").alias("URL"),
        F.col("occurrence_count").alias("Occurrence Count"),
        F.when(F.col("resolved_at").isNotNull(), F.lit("Yes")).otherwise(F.lit("No")).alias("Resolved"),
        FMT.iso8601(F.col("created_at")).alias("Created At"),
        FMT.iso8601(F.col("updated_at")).alias("Updated At"),
    )


def cli_export_json(rows: DataFrame) -> DataFrame:
    body = F.struct(
        "error_id",
        "message",
        "exception_class",
        "status_code",
        "request_method",
        "request_url",
        "occurrence_count",
        F.col("resolved_at").isNotNull().alias("resolved"),
        FMT.iso8601(F.col("resolved_at")).alias("resolved_at"),
        FMT.iso8601(F.col("created_at")).alias("created_at"),
        FMT.iso8601(F.col("updated_at")).alias("updated_at"),
    )
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headed CSV, one file per partition (no driver-side assembly)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
