"""Joins and lookups (J1-J7) and the occurrence roll-up.

No join here pairs rows within a group: the related-errors join first keeps
at most 6 candidates per endpoint (``row_number() <= 6`` - Spark inserts a
map-side ``WindowGroupLimit`` before the shuffle, so a hot endpoint sends at
most 6 rows per map task), and the trend join pre-aggregates the trend side
to one row per error code.  Null keys use null-safe equality where a null is
a legal key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import config as C

ATTRS = ("exception_class", "error_code", "message", "status_code", "request_method", "request_url", "user_id")


def null_safe_on(left: DataFrame, right: DataFrame, keys) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def error_occurrences(err: DataFrame) -> DataFrame:
    """Roll repeated error_ids into one row: count, first/last seen and the
    first sighting's attributes (``min_by`` on (created_at, id)).  Partial
    aggregation runs per map task, so a hot error_id is combined before the
    shuffle."""
    order = F.struct("created_at", "id")
    first = F.min_by(F.struct(F.col("id"), *[F.col(a) for a in ATTRS]), order)
    g = err.groupBy("error_id").agg(
        first.alias("f"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("created_at").alias("first_occurred_at"),
        F.max("created_at").alias("last_occurred_at"),
    )
    return g.select("error_id", "f.id", *[f"f.{a}" for a in ATTRS], "occurrence_count", "first_occurred_at", "last_occurred_at")


def errors_with_trends(err: DataFrame, trends: DataFrame) -> DataFrame:
    """Each error with its code's trend rows (flattened to counts).

    The trend side is aggregated to one row per error_code first; a null code
    never matches (plain equality)."""
    per_code = trends.filter(F.col("error_code").isNotNull()).groupBy("error_code").agg(
        F.count(F.lit(1)).alias("trend_rows"), F.sum("count").alias("trend_total")
    )
    j = err.select("id", "error_code").join(per_code, on="error_code", how="left")
    return j.select(
        "id",
        "error_code",
        F.coalesce(F.col("trend_rows"), F.lit(0)).alias("trend_rows"),
        F.coalesce(F.col("trend_total"), F.lit(0)).cast("bigint").alias("trend_total"),
    )


def trend_chunks(trends: DataFrame) -> DataFrame:
    """The trend rows of each error_code, nested by month: (error_code, month, trends).

    A list holds a month's (date, status_code, count) rows in order, so its
    length is bounded by days and status codes however often a code occurs.
    """
    rows = F.array_sort(F.collect_list(F.struct("date", "status_code", "count")))
    known = trends.filter(F.col("error_code").isNotNull())
    return known.groupBy("error_code", F.trunc("date", "month").alias("month")).agg(rows.alias("trends"))


def errors_with_trend_rows(err: DataFrame, trends: DataFrame) -> DataFrame:
    """Each error with the trend rows of its code nested, a row a month: (id, error_id, error_code, month, trends).

    An error whose code is null or has no trend has one row with a null month
    and an empty list.
    """
    none = F.array().cast("array<struct<date:date,status_code:int,count:bigint>>")
    j = err.select("id", "error_id", "error_code").join(trend_chunks(trends), "error_code", "left")
    return j.select("id", "error_id", "error_code", "month", F.coalesce("trends", none).alias("trends"))


def related_errors(err: DataFrame, limit: int = 5) -> DataFrame:
    """For every error: the ``limit`` newest other errors on the same endpoint."""
    newest = Window.partitionBy("request_url").orderBy(F.col("related_at").desc(), F.col("related_id").desc())
    cand = (
        err.select("request_url", F.col("id").alias("related_id"), F.col("created_at").alias("related_at"))
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= limit + 1)
    )
    # one array of at most limit + 1 ids an endpoint, newest first: the join needs no second ranking
    newest_ids = cand.groupBy("request_url").agg(F.array_sort(F.collect_list(F.struct("rn", "related_id"))).alias("newest"))
    others = F.slice(F.filter("newest", lambda x: x["related_id"] != F.col("id")), 1, limit)
    ranked = err.select("id", "request_url").join(newest_ids, on="request_url").select("id", F.posexplode(others).alias("pos", "x"))
    return ranked.select("id", F.col("x.related_id").alias("related_id"), (F.col("pos") + 1).alias("rank"))


def related_for(err: DataFrame, ident: int, limit: int = 5) -> DataFrame:
    """Related errors of one error: a filter and a top-k."""
    me = err.filter(F.col("id") == ident).select(F.col("request_url").alias("u"))
    others = err.join(me, err["request_url"] == me["u"], "left_semi").filter(F.col("id") != ident)
    return others.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def known_errors(batch: DataFrame, table: DataFrame) -> DataFrame:
    return batch.join(table.select("error_id"), on="error_id", how="left_semi")


def new_errors(batch: DataFrame, table: DataFrame) -> DataFrame:
    return batch.join(table.select("error_id"), on="error_id", how="left_anti")


def breaker_get_or_create(calls: DataFrame, cb: DataFrame, cfg: C.BreakerConfig = C.BreakerConfig()) -> DataFrame:
    """One breaker per distinct (service, operation) call key: the existing
    row (lowest id on duplicates) or a new closed one with default limits."""
    keys = calls.select("service", "operation").distinct()
    existing = cb.groupBy("service", "operation").agg(
        F.min_by(F.struct("id", "state", "failure_threshold", "recovery_timeout", "success_threshold"), F.col("id")).alias("b")
    )
    j = keys.join(existing, null_safe_on(keys, existing, ["service", "operation"]), "left").select(
        keys["service"], keys["operation"], F.col("b")
    )
    found = F.col("b").isNotNull()
    return j.select(
        "service",
        "operation",
        (~found).alias("created"),
        F.col("b.id").alias("breaker_id"),
        F.when(found, F.col("b.state")).otherwise(F.lit("closed")).alias("state"),
        F.when(found, F.col("b.failure_threshold")).otherwise(F.lit(cfg.failure_threshold)).alias("failure_threshold"),
        F.when(found, F.col("b.recovery_timeout")).otherwise(F.lit(cfg.recovery_timeout_s)).alias("recovery_timeout"),
        F.when(found, F.col("b.success_threshold")).otherwise(F.lit(cfg.success_threshold)).alias("success_threshold"),
    )


def trend_merge(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge trend increments into the trend table on the null-safe
    (date, error_code, status_code) key: counts add, hourly slots add."""
    keys = ["date", "error_code", "status_code"]
    t = table.alias("t")
    b = batch.alias("b")
    cond = None
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}"))
        cond = c if cond is None else cond & c
    j = t.join(b, cond, "full_outer")
    zero = F.array_repeat(F.lit(0), 24)
    hourly = F.zip_with(
        F.coalesce(F.col("t.hourly_distribution"), zero),
        F.coalesce(F.col("b.hourly_distribution"), zero),
        lambda x, y: (x + y).cast("int"),
    )
    return j.select(
        *[F.coalesce(F.col(f"t.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        (F.coalesce(F.col("t.count"), F.lit(0)) + F.coalesce(F.col("b.count"), F.lit(0))).alias("count"),
        hourly.alias("hourly_distribution"),
    )


def fallback_resolution(failed: DataFrame, registry: DataFrame, transient: Column) -> DataFrame:
    """Fallback for each failed call: ``service.operation`` strategy, else the
    ``service`` strategy, else the transient / permanent default.

    ``registry`` (key, strategy) has no size bound, so the joins carry no
    hint.  A key that is registered more than once counts once (its smallest
    strategy), so no call is multiplied."""
    reg = registry.groupBy("key").agg(F.min("strategy").alias("strategy"))
    full_key = F.when(F.col("operation").isNotNull() & (F.col("operation") != ""), F.concat_ws(".", "service", "operation")).otherwise(
        F.col("service")
    )
    x = failed.withColumn("_full", full_key).withColumn("_transient", transient)
    r1 = reg.select(F.col("key").alias("_k1"), F.col("strategy").alias("_s1"))
    r2 = reg.select(F.col("key").alias("_k2"), F.col("strategy").alias("_s2"))
    j = x.join(r1, x["_full"] == r1["_k1"], "left").join(r2, x["service"] == r2["_k2"], "left")
    default = F.when(F.col("_transient"), F.lit(C.FALLBACK_TRANSIENT[0])).otherwise(F.lit(C.FALLBACK_PERMANENT[0]))
    out = F.coalesce(F.col("_s1"), F.col("_s2"), default)
    source = F.when(F.col("_s1").isNotNull(), "operation").when(F.col("_s2").isNotNull(), "service").otherwise("default")
    return j.select(*failed.columns, out.alias("fallback"), source.alias("fallback_source"))


def missing_ids(requested: DataFrame, table: DataFrame) -> DataFrame:
    return requested.select("id").distinct().join(table.select("id"), on="id", how="left_anti")
