"""Streams over folders of files: several batches, restarts, repeats, late rows and compaction all equal batch."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from faultline import config as C
from faultline.operators import breaker as B
from faultline.operators import trends as TR
from faultline.operators.joins import error_occurrences
from faultline.plans.q_breaker import CFG
from faultline.sources import tables as T
from faultline.streaming import jobs as S

COLLECT = ["error_id", "id", "message", "occurrence_count", "first_occurred_at", "last_occurred_at"]
TRENDS = ["date", "error_code", "status_code", "count", "hourly_distribution"]
BREAKER = ["service", "operation", "state", "failure_count", "last_failure_at", "opened_at", "next_attempt_at", "calls", "rejected", "trips"]


def rows(df, cols):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*cols).collect()), key=repr)


class Folder:
    """``events.parquet`` as a folder that files are added to, and paths for a stream's table."""

    def __init__(self, spark, sf, base, parts=5, late=()):
        self.spark, self.dir = spark, str(base / "in")
        events = T.read(spark, sf, "events")
        edge = events.count() // parts + 1
        cut = [events.where((F.col("event_id") >= i * edge) & (F.col("event_id") < (i + 1) * edge)) for i in range(parts)]
        self.left = [cut[i] for i in range(parts) if i not in late] + [cut[i] for i in late]

    def add(self, n):
        for part in self.left[:n]:
            part.coalesce(1).write.mode("append").parquet(f"{self.dir}/events.parquet")
        self.left = self.left[n:]


@pytest.fixture
def folder(spark, sf, tmp_path):
    return lambda **how: Folder(spark, sf, tmp_path / uuid.uuid4().hex, **how)


def epochs(table):
    return table._folders()


def test_collect_over_files_and_restarts(spark, sf, folder, tmp_path):
    f, out = folder(late=(1,)), str(tmp_path / "collect")
    f.add(3)
    for more in (0, 2, 0):  # a restart without new files changes nothing
        f.add(more)
        _, table = S.collect_stream(spark, f.dir, path=out, max_files=1, compact_every=2)
    assert rows(S.collected(table), COLLECT) == rows(error_occurrences(T.errors(spark, sf)), COLLECT)
    bases, last = epochs(table)
    assert bases and len(last) <= 2 * 2  # earlier epochs are folded
    want = rows(TR.daily_trends(T.errors(spark, sf), "first"), TRENDS)
    assert rows(S.first_sighting_trends(S.collected(table)), TRENDS) == want


def test_trends_over_files_with_late_rows(spark, sf, folder, tmp_path):
    f = folder(late=(0, 2))
    f.add(5)
    _, table = S.daily_trend_stream(spark, f.dir, path=str(tmp_path / "trends"), max_files=1, compact_every=3)
    got = rows(table.read(), TRENDS)
    assert got == rows(TR.daily_trends(T.errors(spark, sf), "occurrences"), TRENDS)
    assert all(sum(r[4]) == r[3] for r in got) and len(epochs(table)[0]) == 1


def test_live_feed_over_files(spark, sf, folder, tmp_path):
    f, out = folder(), str(tmp_path / "live")
    f.add(2)
    S.live_feed(spark, f.dir, path=out, max_files=1)
    f.add(3)
    _, table = S.live_feed(spark, f.dir, path=out, max_files=1)
    got = spark.read.parquet(table)
    assert got.count() == got.select("id").distinct().count() == T.errors(spark, sf).count()


def test_breakers_over_files_and_restarts(spark, sf, folder, tmp_path):
    f, out = folder(), str(tmp_path / "breakers")
    f.add(2)
    S.breaker_stream(spark, f.dir, CFG, path=out, max_files=1, compact_every=2)
    f.add(3)
    _, table = S.breaker_stream(spark, f.dir, CFG, path=out, max_files=1, compact_every=2)
    want = B.breaker_fold(T.calls(spark, sf).select("seq", "ts", "service", "operation", "ok"), CFG)
    assert rows(S.breaker_states(table), BREAKER) == rows(want, BREAKER)


def test_time_zone_does_not_matter(spark, sf, folder, tmp_path):
    f = folder()
    f.add(5)
    want = rows(B.breaker_fold(T.calls(spark, sf).select("seq", "ts", "service", "operation", "ok"), CFG), BREAKER)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        _, table = S.breaker_stream(spark, f.dir, CFG, path=str(tmp_path / "b"))
        assert rows(S.breaker_states(table), BREAKER) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def plain_fold(calls, breakers, cfg):
    """(service, operation) -> (state, failures, rejected, trips), call by call."""
    out = {}
    for seq, ts, service, operation, ok in sorted(calls, key=lambda c: (c[1], c[0])):
        key = (service, operation)
        limits = breakers.get(key, ("closed", 0, cfg.failure_threshold, cfg.recovery_timeout_s, None))
        state, f, nxt, rejected, trips = out.get(key, (limits[0], limits[1], limits[4], 0, 0))
        if state == "open" and not (nxt and nxt < ts):
            rejected += 1
        elif ok:
            state, f = {"half_open": ("closed", 0), "open": ("half_open", f)}.get(state, (state, f))
        else:
            f += 1
            if f >= limits[2]:
                state, nxt, trips = "open", ts + dt.timedelta(seconds=limits[3]), trips + 1
        out[key] = (state, f, nxt, rejected, trips)
    return {k: (v[0], v[1], v[3], v[4]) for k, v in out.items()}


def test_breaker_stream_with_limits_and_stored_state(spark, sf, folder, tmp_path):
    f = folder()
    f.add(5)
    calls = [tuple(r) for r in T.calls(spark, sf).select("seq", "ts", "service", "operation", "ok").collect()]
    rng, stored = random.Random(2), {}
    for key in sorted({c[2:4] for c in calls}, key=repr)[::2]:
        state = rng.choice(["closed", "open", "half_open"])
        nxt = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(200)) if state == "open" else None
        stored[key] = (state, rng.randrange(3), rng.randrange(2, 6), rng.randrange(600, 90_000), nxt)
    table = spark.createDataFrame(
        [(*k, *v) for k, v in stored.items()],
        "service string, operation string, state string, failure_count int, failure_threshold int, recovery_timeout int, next_attempt_at timestamp_ntz",
    )
    _, made = S.breaker_stream(spark, f.dir, C.BreakerConfig(3, 7200), path=str(tmp_path / "b"), max_files=2, breakers=table)
    got = {(r.service, r.operation): (r.state, r.failure_count, r.rejected, r.trips) for r in S.breaker_states(made).collect()}
    assert got == plain_fold(calls, stored, C.BreakerConfig(3, 7200))


def test_repeated_epochs_and_broken_writes(spark, sf, tmp_path):
    err = T.errors(spark, sf)
    table = S.PartialTable(spark, str(tmp_path / "t"), S.fold_trends, every=2)
    with pytest.raises(FileNotFoundError):
        table.read()
    parts = [S.trend_partials(err.where(F.col("id") % 5 == i)) for i in range(5)]
    for epoch, part in enumerate(parts):
        table.append(part, epoch)
        table.append(part, epoch)  # a batch that is run again
    want = rows(TR.daily_trends(err, "occurrences"), TRENDS)
    assert rows(table.read(), TRENDS) == want
    parts[0].write.parquet(f"{table.path}/base=9")  # a compaction that did not commit
    (tmp_path / "t" / "base=9" / "_SUCCESS").unlink()
    assert rows(table.read(), TRENDS) == want


def test_sinks_use_shared_checkpoint_dir(spark, sf):
    _, table = S.live_feed(spark, sf)
    strip = lambda p: p.replace("file:", "")
    assert strip(table).startswith(strip(spark.sparkContext.getCheckpointDir()))
    assert spark.read.parquet(table).count() == T.errors(spark, sf).count()
