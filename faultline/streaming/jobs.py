"""Structured Streaming forms of the collectors.

Sources are file streams over ``events.parquet``, a folder of files that grows
or a single file; ``max_files`` bounds the files, and so the rows, of a
micro-batch.  Sinks are tables under the cluster's shared
``spark.checkpoint.dir`` or in the caller's ``path``, with their stream
checkpoints next to them: a job restarted with the same ``path`` goes on where
it stopped.

Roll-ups keep no state between micro-batches.  Each batch writes what it adds
(counts, sums, first and last sightings) as partial rows to its own ``epoch=N``
folder, which a repeated batch overwrites; ``PartialTable`` folds the partial
rows of all epochs when it is read, and every so many epochs folds the earlier
ones into one ``base=N`` folder.  So every row counts however late it is, and
neither the state nor the number of folders grows with time.  The breaker
machine is stateful, and forgets breakers that are back at rest.

Event time is the zone-less wall clock of the events, in microseconds;
nothing depends on the session's time zone.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from faultline import config as C
from faultline.operators.breaker import from_micros, micros, with_limits
from faultline.session import ensure_checkpoint_dir
from faultline.sources import tables as T

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Epochs after which a table of partial rows folds the earlier ones.
COMPACT_EVERY = 20


def shared_dir(spark: SparkSession, name: str, path: str | None = None) -> str:
    """The folder of a stream's table and checkpoint: ``path`` if given, so a
    restarted job goes on where it stopped; else a fresh one under the shared
    checkpoint directory."""
    if path:
        return path
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _fs(spark: SparkSession, path: str):
    """(file system, path) as Spark's readers see them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The events as a stream of files: all of the folder ``events.parquet``, as they arrive, or that one file."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    source = os.path.join(sf_dir, "events.parquet")
    fs, path = _fs(spark, source)
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(source)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run(writer, available_now: bool, processing_time: str | None):
    if available_now:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return writer.trigger(processingTime=processing_time or "5 seconds").start()


class PartialTable:
    """A table of partial rows by epoch under ``path``, with the ``fold`` that makes one row a key of many.

    ``fold`` keeps the columns, so folding what was folded changes nothing.  A
    folder counts once its write has committed (``_SUCCESS``); a ``base=N``
    stands for all epochs before N.  Folders that a base replaces stay for one
    more compaction, for readers that have listed them.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], every: int | None = None):
        self.spark, self.path, self.fold = spark, path, fold
        self.every = COMPACT_EVERY if every is None else every

    def _folders(self) -> tuple[list[int], list[int]]:
        """(bases, epochs) that are committed, ascending."""
        fs, root = _fs(self.spark, self.path)
        found: dict[str, list[int]] = {"base": [], "epoch": []}
        if fs.exists(root):
            for status in fs.listStatus(root):
                kind, _, number = status.getPath().getName().partition("=")
                done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
                if kind in found and fs.exists(done):
                    found[kind].append(int(number))
        return sorted(found["base"]), sorted(found["epoch"])

    def _rows(self, until: int | None = None) -> DataFrame | None:
        bases, epochs = self._folders()
        bases = [b for b in bases if until is None or b <= until]
        start = bases[-1] if bases else 0
        folders = [f"base={start}"] if bases else []
        folders += [f"epoch={e}" for e in epochs if e >= start and (until is None or e < until)]
        return self.spark.read.parquet(*(os.path.join(self.path, f) for f in folders)) if folders else None

    def append(self, rows: DataFrame, epoch: int) -> None:
        """Writes the partial rows of one epoch; all epochs before it are committed, as streams run them in order."""
        rows.write.mode("overwrite").parquet(os.path.join(self.path, f"epoch={epoch}"))
        if epoch and epoch % self.every == 0:
            self.compact(epoch)

    def compact(self, until: int) -> None:
        """Folds the epochs before ``until`` into one base, then removes what the base before that replaced."""
        bases, epochs = self._folders()
        rows = self._rows(until)
        if rows is None or until in bases:
            return
        self.fold(rows).write.mode("overwrite").parquet(os.path.join(self.path, f"base={until}"))
        fs, _ = _fs(self.spark, self.path)
        if bases:
            old = [f"base={b}" for b in bases[:-1]] + [f"epoch={e}" for e in epochs if e < bases[-1]]
            for name in old:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, name)), True)

    def read(self) -> DataFrame:
        rows = self._rows()
        if rows is None:
            raise FileNotFoundError(f"no epoch of {self.path} is complete yet")
        return self.fold(rows)


def _partial_run(stream: DataFrame, table: PartialTable, make: Callable[[DataFrame, int], DataFrame], out: str, available_now: bool, refresh: str, mode: str):
    write = lambda batch, epoch: table.append(make(batch, epoch), epoch)
    w = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", os.path.join(out, "_checkpoint"))
    return _run(w, available_now, refresh), table


# ---- X7: live feed -------------------------------------------------------------


def live_feed(spark: SparkSession, sf_dir: str, available_now: bool = True, refresh: str = "10 seconds",
              path: str | None = None, max_files: int | None = None):
    """New error rows in the live-feed shape, appended to a parquet table.

    Returns ``(query, table_path)``."""
    from faultline.operators.topk import live_shape

    rows = live_shape(T.errors_from_events(event_stream(spark, sf_dir, max_files)))
    out = shared_dir(spark, "live_feed", path)
    w = rows.writeStream.format("parquet").option("path", os.path.join(out, "table")).option(
        "checkpointLocation", os.path.join(out, "_checkpoint")
    )
    return _run(w, available_now, refresh), os.path.join(out, "table")


# ---- X6: running daily trends ----------------------------------------------------

TREND_KEYS = ["date", "error_code", "status_code"]


def trend_partials(err: DataFrame, time: str = "created_at") -> DataFrame:
    slots = [F.count_if(F.hour(time) == h).cast("int") for h in range(24)]
    return err.groupBy(F.to_date(time).alias("date"), "error_code", "status_code").agg(F.count(F.lit(1)).alias("count"), F.array(*slots).alias("hourly_distribution"))


def fold_trends(rows: DataFrame) -> DataFrame:
    slots = [F.sum(F.get("hourly_distribution", F.lit(h))).cast("int") for h in range(24)]
    return rows.groupBy(*TREND_KEYS).agg(F.sum("count").alias("count"), F.array(*slots).alias("hourly_distribution"))


def daily_trend_stream(spark: SparkSession, sf_dir: str, available_now: bool = True, refresh: str = "5 seconds",
                       path: str | None = None, max_files: int | None = None, compact_every: int | None = None):
    """Per (day, error_code, status_code): count and 24 hourly slots.  Returns ``(query, PartialTable)``."""
    out = shared_dir(spark, "daily_trends", path)
    table = PartialTable(spark, os.path.join(out, "table"), fold_trends, compact_every)
    err = T.errors_from_events(event_stream(spark, sf_dir, max_files))
    return _partial_run(err, table, lambda batch, epoch: trend_partials(batch), out, available_now, refresh, "append")


# ---- X1: continuous collect (occurrence roll-up) -------------------------------


def collect_partials(err: DataFrame) -> DataFrame:
    """Occurrences by error_id with the attributes of the first sighting, ``first`` being ordered by time and id."""
    from faultline.operators.joins import ATTRS

    sighting = F.struct(F.col("created_at").alias("at"), F.col("id"), F.struct(*ATTRS).alias("attrs"))
    return err.groupBy("error_id").agg(
        F.min_by(sighting, F.struct("created_at", "id")).alias("first"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.max("created_at").alias("last_occurred_at"),
    )


def fold_collected(rows: DataFrame) -> DataFrame:
    return rows.groupBy("error_id").agg(
        F.min_by("first", F.struct("first.at", "first.id")).alias("first"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.max("last_occurred_at").alias("last_occurred_at"),
    )


def collected(table: PartialTable) -> DataFrame:
    """The roll-up as ``error_occurrences`` has it: one row per error_id."""
    return table.read().select(
        "error_id", "first.id", "first.attrs.*", "occurrence_count", F.col("first.at").alias("first_occurred_at"), "last_occurred_at"
    )


def collect_stream(spark: SparkSession, sf_dir: str, available_now: bool = True, refresh: str = "5 seconds",
                   path: str | None = None, max_files: int | None = None, compact_every: int | None = None):
    """Roll incoming errors up per error_id (count, first/last seen, first sighting's attributes).

    Returns ``(query, PartialTable)``; ``collected`` reads it."""
    out = shared_dir(spark, "collect", path)
    table = PartialTable(spark, os.path.join(out, "table"), fold_collected, compact_every)
    err = T.errors_from_events(event_stream(spark, sf_dir, max_files))
    return _partial_run(err, table, lambda batch, epoch: collect_partials(batch), out, available_now, refresh, "append")


def first_sighting_trends(rollup: DataFrame) -> DataFrame:
    """Trend rows that count first sightings only, from the collected roll-up
    (one row per error_id with its first sighting's time and attributes)."""
    return trend_partials(rollup, "first_occurred_at")


# ---- X2: breaker state machine as a stateful stream --------------------------------

BREAKER_STATE = "state string, failures long, next_attempt long"
BREAKER_OUT = (
    "service string, operation string, state string, failure_count long, last_failure long, opened long, "
    "next_attempt long, calls long, rejected long, trips long"
)


def _breaker_step(key, pdfs, state):
    """Advances one breaker over its calls of a micro-batch, in (ts, seq) order; times are microseconds.

    Only this breaker's slice of one micro-batch is in memory.  What is kept
    between batches is how it differs from its start: a breaker that starts at
    rest (closed, no failures) and is at rest again is forgotten.
    """
    batch = pd.concat(list(pdfs)).sort_values(["t", "seq"])
    first = batch.iloc[0]
    threshold, wait = int(first["threshold"]), int(first["recovery"]) * 1_000_000
    start = (first["start_state"], int(first["start_failures"]), None if pd.isna(first["start_next"]) else int(first["start_next"]))
    st, f, nxt = state.get if state.exists else start
    calls = rejected = trips = 0
    last = opened = next_made = None
    for t, ok in zip(batch["t"].tolist(), batch["ok"].tolist()):
        calls += 1
        if st == "open" and not (nxt is not None and nxt < t):
            rejected += 1
        elif ok:
            if st == "half_open":
                st, f = "closed", 0
            elif st == "open":
                st = "half_open"
        else:
            f += 1
            last = t
            if f >= threshold:
                st, opened, nxt, trips = "open", t, t + wait, trips + 1
                next_made = nxt
    if (st, f) == ("closed", 0) and start[:2] == ("closed", 0):
        if state.exists:
            state.remove()
    else:
        state.update((st, f, nxt))
    service, operation = key
    row = [service, operation, st, f, last, opened, next_made, calls, rejected, trips]
    kinds = [c.split()[0] for c in BREAKER_OUT.split(", ")]
    yield pd.DataFrame([row], columns=kinds).astype({c: "Int64" for c in kinds[3:]})


def fold_breakers(rows: DataFrame) -> DataFrame:
    """The newest state of each breaker; counts add up and times only grow."""
    return rows.groupBy("service", "operation").agg(
        F.max_by("state", "epoch").alias("state"), F.max_by("failure_count", "epoch").alias("failure_count"),
        *[F.max(c).alias(c) for c in ("last_failure", "opened", "next_attempt", "epoch")],
        *[F.sum(c).alias(c) for c in ("calls", "rejected", "trips")],
    )


def breaker_states(table: PartialTable) -> DataFrame:
    """One row per breaker as ``breaker_fold`` has it."""
    times = (("last_failure", "last_failure_at"), ("opened", "opened_at"), ("next_attempt", "next_attempt_at"))
    return table.read().select(
        "service", "operation", "state", "failure_count", *[from_micros(F.col(a)).alias(b) for a, b in times], "calls", "rejected", "trips"
    )


def breaker_stream(spark: SparkSession, sf_dir: str, cfg: C.BreakerConfig = C.BreakerConfig(), available_now: bool = True, refresh: str = "15 seconds",
                   path: str | None = None, max_files: int | None = None, compact_every: int | None = None, breakers: DataFrame | None = None):
    """Breaker states kept current from a call stream (``applyInPandasWithState``).

    ``breakers`` gives stored breakers (service, operation, state, failure_count,
    failure_threshold, recovery_timeout, next_attempt_at), one row a breaker,
    whose limits and state calls start from; others follow ``cfg``.  Calls are
    taken in the order of their files.  Returns ``(query, PartialTable)``;
    ``breaker_states`` reads it."""
    calls = T.calls_from_events(event_stream(spark, sf_dir, max_files)).select("seq", micros(F.col("ts")).alias("t"), "service", "operation", "ok")
    keyed = with_limits(calls, cfg, breakers).groupBy("service", "operation")
    states = keyed.applyInPandasWithState(_breaker_step, BREAKER_OUT, BREAKER_STATE, "update", GroupStateTimeout.NoTimeout)
    out = shared_dir(spark, "breakers", path)
    table = PartialTable(spark, os.path.join(out, "table"), fold_breakers, compact_every)
    return _partial_run(states, table, lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch).cast("long")), out, available_now, refresh, "update")
