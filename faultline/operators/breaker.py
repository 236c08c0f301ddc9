"""Circuit-breaker replay over a call log.

The breaker is a sequential state machine per (service, operation).  A log is
range-partitioned by (service, operation, time) and cut into segments of at most
SEGMENT calls, so a breaker with a third of all calls is spread over as many
tasks as any other data.  Three passes replay it:

1. each segment is reduced to what it does to any state that may enter it: a
   few numbers for a closed or half-open breaker and, for an open one, a step
   function of the time of its next attempt.  Between trips the machine moves by
   lookups (the call after the wait, the threshold-th failure from here), so
   one backward pass over a segment answers for all its calls;
2. the segments of a breaker are composed in order, a summary row at a time,
   which gives every segment the state that it starts in;
3. each segment is replayed from that state, all of them in parallel.

Limits and starting state belong to a breaker: its stored row gives its
threshold, wait, state, failures and next attempt; others follow the config and
start closed.  Lineage is cut by tables in the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import pickle
import uuid
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import config as C
from faultline.session import ensure_checkpoint_dir

KEY = ("service", "operation")
#: Calls of a segment, which is what one task holds at a time.
SEGMENT = 100_000
CLOSED, OPEN, HALF = 0, 1, 2
STATES = ("closed", "open", "half_open")
NEVER = 1 << 62


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_micros(t: Column) -> Column:
    """The zone-less timestamp of microseconds since 1970; the inverse of ``micros``."""
    return F.timestamp_add("MICROSECOND", t, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a parquet table into the shared checkpoint
    folder and reading it back (computed once, unlike an unpersisted
    ``checkpoint()``, which evaluates its plan twice)."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "faultline", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Columns of a call with its breaker's limits and the state that it had before the log.
LIMITS = ("threshold", "recovery", "start_state", "start_failures", "start_next")


def with_limits(calls: DataFrame, cfg: C.BreakerConfig, breakers: DataFrame | None) -> DataFrame:
    """Calls with the limits and the stored state of their breaker (``LIMITS``), else those of ``cfg`` at rest.

    ``breakers`` has one row a breaker: service, operation, state, failure_count,
    failure_threshold, recovery_timeout and next_attempt_at.
    """
    rest = {"threshold": F.lit(cfg.failure_threshold), "recovery": F.lit(cfg.recovery_timeout_s), "start_state": F.lit("closed"),
            "start_failures": F.lit(0).cast("long"), "start_next": F.lit(None).cast("long")}
    if breakers is None:
        return calls.withColumns(rest)
    b = breakers.select(
        F.col("service").alias("__s"), F.col("operation").alias("__o"), F.col("failure_threshold").alias("threshold"),
        F.col("recovery_timeout").alias("recovery"), F.col("state").alias("start_state"),
        F.col("failure_count").cast("long").alias("start_failures"), micros(F.col("next_attempt_at")).alias("start_next"),
    )
    same = F.col("service").eqNullSafe(F.col("__s")) & F.col("operation").eqNullSafe(F.col("__o"))
    joined = calls.join(b, same, "left").drop("__s", "__o")
    return joined.withColumns({c: F.coalesce(c, v) for c, v in rest.items()})


# ---- the machine --------------------------------------------------------------------


@dataclass(frozen=True)
class State:
    """kind, failures, next attempt; ``fresh`` while no call was let through yet."""

    kind: int
    failures: int
    next: int = NEVER
    fresh: bool = False


@dataclass(frozen=True)
class Exit:
    """The state at the end of a segment; its failures are added to those at the entry unless ``reset``."""

    kind: int
    next: int
    failures: int
    reset: bool

    def more(self, n: int) -> Exit:
        """The exit when ``n`` failures came before."""
        return self if self.reset else Exit(self.kind, self.next, self.failures + n, False)

    def of(self, failures: int) -> State:
        return State(self.kind, self.failures + (0 if self.reset else failures), self.next)


def step(state: State, t: int, ok: bool, threshold: int, wait: int) -> tuple[State, bool]:
    """The state after one call, and whether the call was let through."""
    kind, f = state.kind, state.failures
    if kind == OPEN and not state.next < t:
        return state, False
    if ok:
        if kind == HALF:
            return State(CLOSED, 0, state.next), True
        return State(HALF if kind == OPEN else CLOSED, f, state.next), True
    f += 1
    return (State(OPEN, f, t + wait) if f >= threshold else State(kind, f, state.next)), True


class Segment:
    """What a run of calls does to any state: lookups from one backward pass.

    ``opened[k]`` is the exit of a breaker that is open, with all but one of its
    failures spent, when call k is the first let through.
    """

    def __init__(self, t: np.ndarray, ok: np.ndarray, threshold: int, wait: int):
        self.t, self.n, self.threshold, self.wait = t, len(t), threshold, wait
        self.ok = ok.tolist()
        self.after = np.searchsorted(t, t + wait, "right").tolist()
        self.fails = np.flatnonzero(~ok).tolist()
        self.before = np.concatenate([[0], np.cumsum(~ok)]).tolist()  # failures before each call
        self.times = t.tolist()
        self.opened: list[Exit] = [None] * self.n
        for k in range(self.n - 1, -1, -1):
            self.opened[k] = self._opened(k)

    def trip(self, j: int) -> Exit:
        """The exit after call j opens the breaker (its own failure is not counted)."""
        k = self.after[j]
        return Exit(OPEN, self.times[j] + self.wait, 0, False) if k == self.n else self.opened[k]

    def _opened(self, k: int) -> Exit:
        if not self.ok[k]:
            return self.trip(k).more(1)
        if k + 1 == self.n:
            return Exit(HALF, NEVER, 0, False)
        return self.trip(k + 1).more(1) if not self.ok[k + 1] else self.closed(k + 2)

    def closed(self, i: int) -> Exit:
        """The exit of a breaker that is closed without failures before call i."""
        j = self.before[i] + self.threshold - 1
        if j >= len(self.fails):
            return Exit(CLOSED, NEVER, len(self.fails) - self.before[i], True)
        out = self.trip(self.fails[j])
        return out if out.reset else Exit(out.kind, out.next, out.failures + self.threshold, True)

    def summary(self, start: State) -> dict:
        """What ``advance`` needs; ``start`` is the state that the breaker had before the log."""
        cut = [k for k in range(self.n) if k + 1 == self.n or self.opened[k] != self.opened[k + 1]]
        head = min(self.n, self.threshold + 2)
        out = {
            "until": [self.times[k] for k in cut], "opened": [self.opened[k] for k in cut], "threshold": self.threshold, "wait": self.wait,
            "trips": [self.trip(j) for j in self.fails[: self.threshold]], "failures": len(self.fails), "last": self.times[-1],
            # for the few calls that a breaker with a stored state of its own takes to fall in line
            "head": list(zip(self.times[:head], self.ok[:head])), "head_trips": [self.trip(i) for i in range(head)],
            "head_closed": [self.closed(i) for i in range(head + 1)], "whole": head == self.n,
        }
        if start.fresh:
            state = start
            for t, ok in zip(self.times, self.ok):
                state, _ = step(state, t, ok, self.threshold, self.wait)
            out["from_start"] = state
        return out


def advance(s: dict, state: State) -> State:
    """The state after a segment, from its summary and the state before it."""
    if state.fresh:
        return s["from_start"]
    threshold = s["threshold"]
    if state.kind == CLOSED:
        need = max(threshold - state.failures, 1)
        if need > s["failures"]:
            return State(CLOSED, state.failures + s["failures"], state.next)
        return s["trips"][need - 1].of(state.failures + need)
    if state.kind == OPEN and state.next >= s["last"]:
        return state
    if state.kind == OPEN and state.failures + 1 >= threshold:
        return s["opened"][bisect_right(s["until"], state.next)].of(state.failures)
    # half-open, or open with failures to spare (every call is let through then): a few calls decide
    for i, (t, ok) in enumerate(s["head"]):
        after, _ = step(state, t, ok, threshold, s["wait"])
        if after.kind == OPEN and not ok and after.failures >= threshold:
            return s["head_trips"][i].of(after.failures)
        if after.kind == CLOSED:
            return s["head_closed"][i + 1].of(0)
        state = after
    return state


# ---- the passes ---------------------------------------------------------------------

def _start(row) -> State:
    stored = row.start_state != "closed" or row.start_failures
    return State(STATES.index(row.start_state), int(row.start_failures), NEVER if pd.isna(row.start_next) else int(row.start_next), bool(stored))


def _runs(batches, columns: list[str], most: int | None = None):
    """Frames of consecutive rows that are equal in ``columns``, of at most ``most`` rows, across batch borders."""
    held, size, now = [], 0, None
    for b in batches:
        if not len(b):
            continue
        codes = np.stack([pd.factorize(b[c])[0] for c in columns])  # null is a value of its own, -1
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), len(b)]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(None if pd.isna(b[c].iloc[s]) else b[c].iloc[s] for c in columns)
            if held and key != now:
                yield pd.concat(held)
                held, size = [], 0
            now = key
            while s < e:
                take = e - s if most is None else min(e - s, most - size)
                held.append(b.iloc[s : s + take])
                s, size = s + take, size + take
                if size == most:
                    yield pd.concat(held)
                    held, size = [], 0
    if held:
        yield pd.concat(held)


def _summaries(kept: list[str]):
    """Call rows with their segment, and a row with its summary after each segment."""

    def run(batches):
        part, i = TaskContext.get().partitionId() << 32, 0
        for rows in _runs(batches, list(KEY), SEGMENT):
            first = next(rows.itertuples())
            made = Segment(rows["t"].to_numpy(np.int64), rows["ok"].to_numpy(bool), int(first.threshold), int(first.recovery) * 1_000_000)
            start = _start(first)
            summary = pickle.dumps((start, made.summary(start)))
            yield rows[kept].assign(segment=part + i, summary=None)
            yield rows[kept].iloc[:1].assign(segment=part + i, summary=[summary])
            i += 1

    return run


def _entries(batches):
    """(segment, kind, failures, next): the state before each segment; summaries come in order, one at a time."""
    now, state = None, None
    for b in batches:
        out = []
        for row in b.itertuples():
            start, summary = pickle.loads(row.summary)
            key = (row.service, row.operation) if row.operation == row.operation else (row.service, None)
            if key != now:
                now, state = key, start
            out.append((row.segment, state.kind, state.failures, state.next, state.fresh))
            state = advance(summary, state)
        yield pd.DataFrame(out, columns=["segment", "kind", "failures", "next", "fresh"])


def _replayed(kept: list[str]):
    """Call rows with what became of them, replayed from the state before their segment."""

    def run(batches):
        for rows in _runs(batches, ["segment"]):
            first = next(rows.itertuples())
            threshold, wait = int(first.threshold), int(first.recovery) * 1_000_000
            state = State(int(first.kind), int(first.failures), int(first.next))
            out = []
            for t, ok in zip(rows["t"].tolist(), rows["ok"].tolist()):
                after, through = step(state, t, ok, threshold, wait)
                trip = through and not ok and after.kind == OPEN and after.failures >= threshold
                moved = trip or after.kind != state.kind
                out.append((
                    ("ok" if ok else "failed") if through else "rejected", STATES[state.kind] if moved else None,
                    STATES[after.kind], after.failures, bool(trip), None if after.next == NEVER else after.next,
                ))
                state = after
            made = pd.DataFrame(out, columns=["disposition", "from_state", "state", "failure_count", "trip", "next_attempt"], index=rows.index)
            made["next_attempt"] = made["next_attempt"].astype("Int64")
            yield pd.concat([rows[kept], made], axis=1)

    return run


_REPLAYED = "disposition string, from_state string, state string, failure_count long, trip boolean, next_attempt long"


class Replay:
    """The replay of ``calls`` (seq, ts, service, operation, ok, ..): one table that dispositions, history and states read.

    ``breakers`` gives stored breakers (see ``with_limits``).  Calls of equal
    time go by seq; null services and operations are names like others; an
    empty log gives empty results.  Other columns are kept.
    """

    def __init__(self, calls: DataFrame, cfg: C.BreakerConfig = C.BreakerConfig(), breakers: DataFrame | None = None):
        self.calls = calls
        self.extra = [c for c in calls.columns if c not in (*KEY, "seq", "ts", "ok")]
        narrow = calls.select(*KEY, "seq", micros(F.col("ts")).alias("t"), "ok", *self.extra)
        limits = with_limits(narrow, cfg, breakers).withColumns({c: F.col(c).cast("long") for c in ("threshold", "recovery", "seq")})
        dealt = limits.repartitionByRange(*KEY, "t", "seq").sortWithinPartitions(*KEY, "t", "seq")
        kept = dealt.columns
        schema = T.StructType([*dealt.schema.fields, T.StructField("segment", T.LongType()), T.StructField("summary", T.BinaryType())])
        table = _checkpoint(dealt.mapInPandas(_summaries(kept), schema))
        heads = table.where("summary is not null")
        # a breaker's segments in order: a row for up to SEGMENT calls
        ordered = heads.select(*KEY, "t", "seq", "segment", "summary").repartition(*KEY).sortWithinPartitions(*KEY, "t", "seq")
        entries = ordered.select(*KEY, "segment", "summary").mapInPandas(_entries, "segment long, kind int, failures long, next long, fresh boolean")
        rows = table.where("summary is null").drop("summary").join(_checkpoint(entries.drop("fresh")), "segment")
        rows = rows.repartition("segment").sortWithinPartitions("segment", "t", "seq")
        keep = [*KEY, "seq", "t", "ok", *self.extra]
        out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
        self.rows = _checkpoint(rows.mapInPandas(_replayed(keep), f"{out}, {_REPLAYED}"))

    def dispositions(self) -> DataFrame:
        """The calls with ``disposition``: ok, failed or rejected (breaker open)."""
        return self.rows.select("seq", from_micros(F.col("t")).alias("ts"), *KEY, "ok", *self.extra, "disposition")

    def history(self) -> DataFrame:
        """State transitions (service, operation, ts, from_state, to_state, failure_count)."""
        moved = self.rows.where("from_state is not null")
        return moved.select(*KEY, from_micros(F.col("t")).alias("ts"), "from_state", F.col("state").alias("to_state"), "failure_count")

    def states(self) -> DataFrame:
        """One row per breaker that was called: state, failure count and times after the log."""
        last, time = F.struct("t", "seq"), from_micros
        g = self.rows.groupBy(*KEY).agg(
            F.max_by("state", last).alias("state"), F.max_by("failure_count", last).alias("failure_count"),
            F.max(F.when(F.col("disposition") == "failed", F.col("t"))).alias("failed"), F.max(F.when(F.col("trip"), F.col("t"))).alias("opened"),
            F.coalesce(F.max(F.when(F.col("trip"), F.col("next_attempt"))), F.max("next_attempt")).alias("next"), F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("disposition") == "rejected").alias("rejected"), F.count_if("trip").alias("trips"),
        )
        times = (("failed", "last_failure_at"), ("opened", "opened_at"), ("next", "next_attempt_at"))
        return g.select(*KEY, "state", "failure_count", *[time(F.col(a)).alias(b) for a, b in times], "calls", "rejected", "trips")


def breaker_fold(calls: DataFrame, cfg: C.BreakerConfig = C.BreakerConfig(), breakers: DataFrame | None = None) -> DataFrame:
    return Replay(calls, cfg, breakers).states()


def breaker_history(calls: DataFrame, cfg: C.BreakerConfig = C.BreakerConfig(), breakers: DataFrame | None = None) -> DataFrame:
    return Replay(calls, cfg, breakers).history()


def guarded_calls(calls: DataFrame, cfg: C.BreakerConfig = C.BreakerConfig(), registry: DataFrame | None = None, breakers: DataFrame | None = None) -> DataFrame:
    """Per call: ``ok``, ``failed`` or ``rejected`` (breaker open), and for the
    last two the fallback that answers instead (registered strategy for
    ``service.operation``, then ``service``, then the transient / permanent
    default).  A rejected call carries the open-breaker error, which is not
    transient."""
    from faultline.functions.classify import is_transient
    from faultline.operators.joins import fallback_resolution

    disp = Replay(calls, cfg, breakers).dispositions()
    if registry is None:
        registry = calls.sparkSession.createDataFrame([], "key string, strategy string")
    msg = F.when(F.col("disposition") == "rejected", F.lit("Circuit breaker is open"))
    if "message" in disp.columns:
        msg = msg.otherwise(F.col("message"))
    bad = disp.filter(F.col("disposition") != "ok").withColumn("error_message", msg)
    fb = fallback_resolution(bad, registry, is_transient(F.col("error_message"), F.lit(0)))
    good = disp.filter(F.col("disposition") == "ok").withColumn("error_message", F.lit(None).cast("string"))
    good = good.withColumn("fallback", F.lit(None).cast("string")).withColumn("fallback_source", F.lit(None).cast("string"))
    return good.unionByName(fb).drop("error_message")


# ---- first trips ----------------------------------------------------------------------

BKEY = "bkey"


def with_key(calls: DataFrame) -> DataFrame:
    """Null-safe single-column key for (service, operation)."""
    return calls.withColumn(BKEY, F.to_json(F.struct("service", "operation")))


def running_count(df: DataFrame, flag: Column, order: list[Column], bucket: str, name: str) -> DataFrame:
    """Inclusive running count of ``flag`` per key, via bucket offsets."""
    w = Window.partitionBy(BKEY, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_f", flag.cast("long")).withColumn("_within", F.sum("_f").over(w))
    totals = x.groupBy(BKEY, bucket).agg(F.sum("_f").alias("_bt"))
    wb = Window.partitionBy(BKEY).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(BKEY, bucket, F.coalesce(F.sum("_bt").over(wb), F.lit(0)).alias("_off"))
    return x.join(offs, on=[BKEY, bucket], how="left").withColumn(name, F.col("_within") + F.col("_off")).drop("_f", "_within", "_off")


def breaker_first_trip(calls: DataFrame, cfg: C.BreakerConfig = C.BreakerConfig(), bucket_seconds: int = 3600) -> DataFrame:
    """When each breaker first opens: its threshold-th failure (all calls are
    allowed before the first trip)."""
    c = with_key(calls).withColumn("bucket", _bucket(F.col("ts"), bucket_seconds))
    c = running_count(c, ~F.col("ok"), [F.col("ts"), F.col("seq")], "bucket", "cf")
    hit = c.filter(~F.col("ok") & (F.col("cf") == cfg.failure_threshold))
    return hit.select("service", "operation", F.col("ts").alias("first_trip_at"), F.col("seq"))
