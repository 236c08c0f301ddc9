"""Sort / limit / top-k.

Every ``orderBy(...).limit(k)`` compiles to ``TakeOrderedAndProject``: each
map task keeps its own k best rows and only k x tasks rows reach the final
merge - no full sort and no shuffle of the table.  Orders always end in
``id`` so ties resolve the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions import formatting as FMT
from faultline.operators import filters as P

LIVE_COLUMNS = (
    "id",
    "error_id",
    "message",
    "error_code",
    "status_code",
    "occurrence_count",
    "request_url",
    "request_method",
    "ip_address",
    "created_at",
    "is_resolved",
)


def live_errors(err: DataFrame, limit: int = C.LIVE_FEED_LIMIT) -> DataFrame:
    """Newest ``limit`` errors in the 11-field feed shape."""
    return live_shape(P.newest_first(err).limit(int(limit)))


def live_shape(err: DataFrame) -> DataFrame:
    """The 11 fields of the feed; those that ``err`` lacks are null."""
    cols = []
    for c in LIVE_COLUMNS:
        if c == "created_at":
            cols.append(FMT.iso_string(F.col("created_at")).alias("created_at"))
        elif c in err.columns:
            cols.append(F.col(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    return err.select(*cols)


def top_errors(err: DataFrame, as_of, limit: int = 10, days: int = 7) -> DataFrame:
    """Error *rows* with the highest occurrence_count in the window."""
    P.check_days(days)
    P.check_limit(limit)
    w = P.since_days(err, as_of, days)
    top = w.orderBy(F.col("occurrence_count").desc(), F.col("id").desc()).limit(int(limit))
    return top.select(
        "id",
        "message",
        F.col("error_code").alias("code"),
        "status_code",
        F.col("occurrence_count").alias("count"),
        F.col("request_url").alias("endpoint"),
    )


def top_errors_ranked(top: DataFrame) -> DataFrame:
    """``#n`` rank over an already-limited top list (at most ``limit`` rows)."""
    w = Window.orderBy(F.col("count").desc(), F.col("id").desc())
    return top.select(
        F.concat(F.lit("#"), F.row_number().over(w).cast("string")).alias("rank"),
        FMT.truncate(F.col("message"), 50).alias("message"),
        F.coalesce(F.col("endpoint"), F.lit("N/A")).alias("endpoint"),
        "count",
    )


SORT_COLUMNS = ("updated_at", "occurrence_count", "created_at")


def list_sorted(err: DataFrame, sort_by: str = "updated_at", sort_dir: str = "desc", limit: int = 25, filters: dict | None = None) -> DataFrame:
    P.check_choice(sort_by, set(SORT_COLUMNS))
    P.check_choice(sort_dir, {"asc", "desc"})
    limit = P.check_per_page(limit)
    key = F.col(sort_by).asc() if sort_dir == "asc" else F.col(sort_by).desc()
    tie = F.col("id").asc() if sort_dir == "asc" else F.col("id").desc()
    return P.apply_filters(err, filters).orderBy(key, tie).limit(limit)


def dashboard_widgets(err: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Top 5 error rows and the 10 most recent, tagged by widget."""
    top = top_errors(err, as_of, 5, days).select(F.lit("top_errors").alias("widget"), "id", "message", "status_code")
    recent = P.newest_first(err).limit(10).select(F.lit("recent").alias("widget"), "id", "message", "status_code")
    return top.unionByName(recent)
