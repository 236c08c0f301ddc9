"""Table maintenance as copy-on-write DataFrames.

Each operator returns the *new* table (or the changed rows).
``write_partitioned`` persists it by day; with ``whole=True`` it also removes
the days that a purge or delete has emptied.  ``touched_days`` cuts a table to the days that a change of
a few rows touches, so resolving one error rewrites one day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import config as C
from faultline.operators import filters as P
from faultline.operators.joins import ATTRS, error_occurrences


def upsert_errors(table: DataFrame, batch: DataFrame, sanitize=None) -> DataFrame:
    """Merge a batch of raw errors into the rolled-up error table.

    The batch is rolled up first (one row per error_id), then full-outer
    merged on error_id: counts add, first/last seen widen, and a known
    error keeps its stored attributes.  ``sanitize`` is an optional
    ``DataFrame -> DataFrame`` hook applied to the batch first (custom
    collector sanitising)."""
    if sanitize is not None:
        batch = sanitize(batch)
    b = error_occurrences(batch).alias("b")
    t = table.alias("t")
    j = t.join(b, F.col("t.error_id") == F.col("b.error_id"), "full_outer")
    known = F.col("t.error_id").isNotNull()
    cols = [F.coalesce(F.col("t.error_id"), F.col("b.error_id")).alias("error_id")]
    cols.append(F.when(known, F.col("t.id")).otherwise(F.col("b.id")).alias("id"))
    cols += [F.when(known, F.col(f"t.{a}")).otherwise(F.col(f"b.{a}")).alias(a) for a in ATTRS]
    cols += [
        (F.coalesce(F.col("t.occurrence_count"), F.lit(0)) + F.coalesce(F.col("b.occurrence_count"), F.lit(0))).alias("occurrence_count"),
        F.least(F.col("t.first_occurred_at"), F.col("b.first_occurred_at")).alias("first_occurred_at"),
        F.greatest(F.col("t.last_occurred_at"), F.col("b.last_occurred_at")).alias("last_occurred_at"),
    ]
    return j.select(*cols)


def resolve_error(err: DataFrame, ident, as_of, check: bool = True) -> DataFrame:
    """Mark one error resolved (both flags); reject an already resolved one."""
    if check:
        row = err.filter(F.col("id") == F.lit(ident)).select("is_resolved", "resolved_at").take(1)
        if not row:
            raise LookupError(f"error {ident} not found")
        if row[0]["resolved_at"] is not None or row[0]["is_resolved"]:
            raise ValueError(f"Error {ident} is already resolved")
    hit = F.col("id") == F.lit(ident)
    return err.withColumns(
        {
            "is_resolved": F.when(hit, F.lit(True)).otherwise(F.col("is_resolved")),
            "resolved_at": F.when(hit, P._ts(as_of)).otherwise(F.col("resolved_at")),
        }
    )


def _check_ids(ids) -> None:
    if not isinstance(ids, DataFrame):
        ids = list(ids)
        if not ids:
            raise ValueError("IDs array cannot be empty")


def bulk_resolve(err: DataFrame, ids, as_of) -> DataFrame:
    """Resolve the unresolved errors among ``ids`` (a list or an id DataFrame).

    The id set is joined, never collected, so it has no size cap."""
    _check_ids(ids)
    idf = ids.select("id").distinct() if isinstance(ids, DataFrame) else err.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
    marked = err.join(idf.withColumn("_hit", F.lit(True)), on="id", how="left")
    change = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("resolved_at").isNull()
    return marked.select(
        *[c for c in err.columns if c not in ("is_resolved", "resolved_at")],
        F.when(change, F.lit(True)).otherwise(F.col("is_resolved")).alias("is_resolved"),
        F.when(change, P._ts(as_of)).otherwise(F.col("resolved_at")).alias("resolved_at"),
        change.alias("changed"),
    )


def bulk_resolve_count(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count_if("changed").alias("resolved"))


def bulk_delete(err: DataFrame, ids) -> DataFrame:
    """Table without the rows whose id is in ``ids``."""
    _check_ids(ids)
    if isinstance(ids, DataFrame):
        return err.join(ids.select("id").distinct(), on="id", how="left_anti")
    return err.filter(~F.col("id").isin([int(i) for i in ids]))


def retention_purge(err: DataFrame, as_of, days: int = C.RETENTION_DAYS, status: str = "all") -> DataFrame:
    """Rows kept after purging errors older than ``days`` (only resolved ones
    when ``status='resolved'``); the predicate is null-safe."""
    P.check_choice(status, {"all", "resolved"})
    old = F.col("created_at") < P.days_before(as_of, days)
    if status == "resolved":
        old = old & F.col("resolved_at").isNotNull()
    return err.filter(~F.coalesce(old, F.lit(False)))


def breaker_reset(cb: DataFrame, cond) -> DataFrame:
    """Reset matching breakers: count 0, closed, no next attempt (opened_at and
    last_failure_at are kept)."""
    hit = F.coalesce(cond, F.lit(False))
    return cb.withColumns(
        {
            "failure_count": F.when(hit, F.lit(0)).otherwise(F.col("failure_count")),
            "state": F.when(hit, F.lit("closed")).otherwise(F.col("state")),
            "next_attempt_at": F.when(hit, F.lit(None)).otherwise(F.col("next_attempt_at")),
        }
    )


def breaker_bulk_reset(cb: DataFrame, ident=None, service: str | None = None, state: str | None = None, all_: bool = False) -> DataFrame:
    if all_:
        cond = F.lit(True)
    else:
        parts = []
        if ident is not None:
            parts.append(F.col("id") == F.lit(ident))
        if service is not None:
            parts.append(F.col("service") == service)
        if state is not None:
            parts.append(F.col("state") == state)
        if not parts:
            raise ValueError("give an id, service, state or all")
        cond = parts[0]
        for p in parts[1:]:
            cond = cond & p
    return breaker_reset(cb, cond)


def breaker_auto_reset(cb: DataFrame, as_of) -> DataFrame:
    """Close open breakers whose next attempt has passed; clears opened_at too."""
    hit = F.coalesce((F.col("state") == "open") & (F.col("next_attempt_at") < P._ts(as_of)), F.lit(False))
    return cb.withColumns(
        {
            "state": F.when(hit, F.lit("closed")).otherwise(F.col("state")),
            "failure_count": F.when(hit, F.lit(0)).otherwise(F.col("failure_count")),
            "opened_at": F.when(hit, F.lit(None)).otherwise(F.col("opened_at")),
            "next_attempt_at": F.when(hit, F.lit(None)).otherwise(F.col("next_attempt_at")),
        }
    )


def touched_days(err: DataFrame, cond, day_col: str = "created_at") -> DataFrame:
    """The rows of the days on which a row meets ``cond``: what a change of
    those rows has to rewrite (with ``write_partitioned``)."""
    day = F.to_date(day_col)
    days = err.filter(cond).select(day.alias("_day")).distinct()
    return err.join(days, day.eqNullSafe(F.col("_day")), "left_semi")


def write_partitioned(err: DataFrame, path: str, whole: bool = False, day_col: str | None = None) -> list[str]:
    """Persist an errors table partitioned by day with dynamic overwrite.

    ``whole``: ``err`` is the whole new table, so days of the stored table that
    it no longer has are removed and their folders returned; after a purge or a
    delete this is the form to use, or emptied days would stay behind.
    Otherwise only the days present in ``err`` are replaced.  The day is that of ``created_at``, or of ``first_occurred_at``
    for a rolled-up table without it."""
    day_col = day_col or ("created_at" if "created_at" in err.columns else "first_occurred_at")
    out = err.withColumn("created_date", F.to_date(day_col))
    spark = err.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    before = {s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()} if fs.exists(hadoop) else set()
    emptied: list[str] = []
    if whole and before:
        # one row a day; read before the write, as err may be derived from the stored table
        null_day = "__HIVE_DEFAULT_PARTITION__"
        kept = {f"created_date={r[0] or null_day}" for r in out.select(F.col("created_date").cast("string")).distinct().collect()}
        emptied = sorted(d for d in before - kept if d.startswith("created_date="))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_date").parquet(path)
    for name in emptied:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(hadoop, name), True)
    return emptied


def breaker_record(cb: DataFrame, cond, ok: bool, as_of) -> DataFrame:
    """Record one manual success or failure at ``as_of`` on the matching
    breakers (one step of the breaker state machine, as a column update).

    success: half_open -> closed with count 0; open whose next attempt has
    passed -> half_open.  failure: count + 1, last failure = as_of, and at the
    threshold open with next attempt = as_of + recovery_timeout seconds."""
    t = P._ts(as_of)
    hit = F.coalesce(cond, F.lit(False))
    if ok:
        to_closed = hit & (F.col("state") == "half_open")
        to_half = hit & (F.col("state") == "open") & F.coalesce(F.col("next_attempt_at") < t, F.lit(False))
        return cb.withColumns(
            {
                "state": F.when(to_closed, F.lit("closed")).when(to_half, F.lit("half_open")).otherwise(F.col("state")),
                "failure_count": F.when(to_closed, F.lit(0)).otherwise(F.col("failure_count")),
            }
        )
    count = F.col("failure_count") + 1
    trip = hit & (count >= F.col("failure_threshold"))
    return cb.withColumns(
        {
            "failure_count": F.when(hit, count).otherwise(F.col("failure_count")),
            "last_failure_at": F.when(hit, t).otherwise(F.col("last_failure_at")),
            "state": F.when(trip, F.lit("open")).otherwise(F.col("state")),
            "opened_at": F.when(trip, t).otherwise(F.col("opened_at")),
            "next_attempt_at": F.when(trip, t + F.make_dt_interval(secs=F.col("recovery_timeout"))).otherwise(F.col("next_attempt_at")),
        }
    )
