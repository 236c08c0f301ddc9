"""Breaker replay: golden state-machine cases and equality with a plain
sequential fold on random call logs (including ties and several keys)."""

import datetime as dt
import pickle
import random

import numpy as np
import pytest

from faultline import config as C
from faultline.operators import breaker as B

T0 = dt.datetime(2024, 1, 1)


def calls_df(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts timestamp_ntz, service string, operation string, ok boolean")


def py_fold(rows, cfg):
    """Reference fold in plain Python (one key at a time, in (ts, seq) order)."""
    out, disp = {}, {}
    keys = sorted({(r[2], r[3]) for r in rows}, key=str)
    rec = dt.timedelta(seconds=cfg.recovery_timeout_s)
    for key in keys:
        st, f, nxt, opened, lastf, n, rej, trips = "closed", 0, None, None, None, 0, 0, 0
        for seq, ts, _, _, ok in sorted((r for r in rows if (r[2], r[3]) == key), key=lambda r: (r[1], r[0])):
            n += 1
            allowed = st in ("closed", "half_open") or (st == "open" and nxt < ts)
            if not allowed:
                rej += 1
                disp[seq] = "rejected"
                continue
            disp[seq] = "ok" if ok else "failed"
            if ok:
                if st == "half_open":
                    st, f = "closed", 0
                elif st == "open":
                    st = "half_open"
                continue
            f += 1
            lastf = ts
            if f >= cfg.failure_threshold:
                st, opened, nxt, trips = "open", ts, ts + rec, trips + 1
        out[key] = (st, f, lastf, opened, nxt, n, rej, trips)
    return out, disp


def spark_fold(spark, rows, cfg, breakers=None):
    made = B.Replay(calls_df(spark, rows), cfg, breakers)
    got = {
        (r.service, r.operation): (r.state, r.failure_count, r.last_failure_at, r.opened_at, r.next_attempt_at, r.calls, r.rejected, r.trips)
        for r in made.states().collect()
    }
    return got, {r.seq: r.disposition for r in made.dispositions().collect()}


def seqs(spark, pattern, cfg, gap_s=60, key=("svc", None)):
    rows = [(i, T0 + dt.timedelta(seconds=gap_s * i), key[0], key[1], ch == "s") for i, ch in enumerate(pattern)]
    return spark_fold(spark, rows, cfg)[0][key]


def test_trips_at_threshold(spark):
    cfg = C.BreakerConfig(failure_threshold=3, recovery_timeout_s=3600)
    st = seqs(spark, "fff", cfg)
    assert st[0] == "open" and st[4] is not None


def test_below_threshold_stays_closed(spark):
    cfg = C.BreakerConfig(failure_threshold=3, recovery_timeout_s=3600)
    assert seqs(spark, "ff", cfg)[0] == "closed"


def test_half_open_then_closed(spark):
    cfg = C.BreakerConfig(failure_threshold=2, recovery_timeout_s=30)
    assert seqs(spark, "ffs", cfg)[0] == "half_open"  # next call is 60 s later: timeout passed
    st = seqs(spark, "ffss", cfg)
    assert st[0] == "closed" and st[1] == 0


def test_half_open_failure_retrips(spark):
    cfg = C.BreakerConfig(failure_threshold=2, recovery_timeout_s=30)
    st = seqs(spark, "ffsf", cfg)
    assert st[0] == "open" and st[7] == 2


def test_rejected_while_open(spark):
    cfg = C.BreakerConfig(failure_threshold=2, recovery_timeout_s=3600)
    st = seqs(spark, "ffsss", cfg)
    assert st[0] == "open" and st[6] == 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_sequential_fold(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(B, "SEGMENT", rnd.choice([1, 7, 50]))
    cfg = C.BreakerConfig(failure_threshold=rnd.choice([1, 2, 3]), recovery_timeout_s=rnd.choice([0, 120, 900]))
    rows = []
    keys = [("a", None), ("a", "x"), ("b", None)]
    seq = 0
    for key in keys:
        t = T0
        for _ in range(rnd.randint(20, 80)):
            t = t + dt.timedelta(seconds=rnd.choice([0, 0, 30, 60, 300, 1200]))  # ties on purpose
            rows.append((seq, t, key[0], key[1], rnd.random() < 0.55))
            seq += 1
    want, want_disp = py_fold(rows, cfg)
    got, got_disp = spark_fold(spark, rows, cfg)
    assert got == want
    assert got_disp == want_disp


def test_hot_key_equals_sequential_fold(spark, monkeypatch):
    """One breaker holds most of the calls, spread over many segments."""
    monkeypatch.setattr(B, "SEGMENT", 40)
    rnd = random.Random(7)
    cfg = C.BreakerConfig(failure_threshold=3, recovery_timeout_s=600)
    rows, seq = [], 0
    for key, n in ((("hot", "op"), 900), (("cold", None), 30), (("warm", "x"), 60)):
        t = T0
        for _ in range(n):
            t = t + dt.timedelta(seconds=rnd.choice([0, 20, 60, 240, 900]))
            rows.append((seq, t, key[0], key[1], rnd.random() < 0.6))
            seq += 1
    want, want_disp = py_fold(rows, cfg)
    got, got_disp = spark_fold(spark, rows, cfg)
    assert got == want and got_disp == want_disp


def random_log(rnd, n, gaps=(0, 0, 1, 5, 30, 200)):
    t, out = 1_000_000, []
    for _ in range(n):
        t += rnd.choice(gaps) * 1_000_000
        out.append((t, rnd.random() < rnd.choice([0.2, 0.5, 0.9])))
    return out


def test_segments_compose_to_the_plain_machine():
    """Any limits, any stored state, any cut of the log into segments."""
    rnd = random.Random(11)
    for _ in range(1500):
        threshold, wait = rnd.choice([1, 2, 3, 6]), rnd.choice([0, 3, 60, 500]) * 1_000_000
        log = random_log(rnd, rnd.randrange(1, 40))
        start = B.State(rnd.randrange(3), rnd.randrange(8), rnd.choice([B.NEVER, 0, 1_000_000 * rnd.randrange(500)]))
        start = B.State(start.kind, start.failures, start.next, bool(start.kind or start.failures))
        state, at = start, 0
        while at < len(log):
            part = log[at : at + rnd.choice([1, 2, 3, 10])]
            segment = B.Segment(np.array([t for t, _ in part]), np.array([ok for _, ok in part]), threshold, wait)
            state, at = B.advance(pickle.loads(pickle.dumps(segment.summary(start))), state), at + len(part)
        plain = start
        for t, ok in log:
            plain, _ = B.step(plain, t, ok, threshold, wait)
        assert (state.kind, state.failures) == (plain.kind, plain.failures)
        assert state.kind != B.OPEN or state.next == plain.next


def test_limits_and_stored_states(spark, monkeypatch):
    """Breakers with limits and states of their own, null operations, a third of all calls in one."""
    monkeypatch.setattr(B, "SEGMENT", 25)
    rnd = random.Random(5)
    keys = [("a", None), ("a", ""), ("a", "x"), ("b", None), (None, "y"), ("hot", "z"), ("plain", None)]
    stored, rows = {}, []
    for key in keys[:-1]:
        state = rnd.choice(["closed", "open", "half_open"])
        nxt = T0 + dt.timedelta(seconds=rnd.randrange(40_000)) if state == "open" and rnd.random() < 0.9 else None
        stored[key] = (state, rnd.randrange(5), rnd.randrange(1, 6), rnd.choice([0, 60, 600]), nxt)
    for key in keys:
        t = T0
        for _ in range(300 if key[0] == "hot" else rnd.randrange(5, 120)):
            t += dt.timedelta(seconds=rnd.choice([0, 30, 60, 300]))
            rows.append((len(rows), t, *key, rnd.random() < 0.5))
    schema = "service string, operation string, state string, failure_count int, failure_threshold int, recovery_timeout int, next_attempt_at timestamp_ntz"
    breakers = spark.createDataFrame([(*k, *v) for k, v in stored.items()], schema)
    cfg = C.BreakerConfig(failure_threshold=2, recovery_timeout_s=120)
    want, want_disp = {}, {}
    for key in keys:
        state, f, threshold, wait, nxt = stored.get(key, ("closed", 0, 2, 120, None))
        rejected = trips = 0
        for seq, ts, _, _, ok in sorted((r for r in rows if (r[2], r[3]) == key), key=lambda r: (r[1], r[0])):
            if state == "open" and not (nxt and nxt < ts):
                rejected += 1
                want_disp[seq] = "rejected"
                continue
            want_disp[seq] = "ok" if ok else "failed"
            if ok:
                state, f = {"half_open": ("closed", 0), "open": ("half_open", f)}.get(state, (state, f))
                continue
            f += 1
            if f >= threshold:
                state, nxt, trips = "open", ts + dt.timedelta(seconds=wait), trips + 1
        want[key] = (state, f, nxt, rejected, trips)
    got, disp = spark_fold(spark, rows, cfg, breakers)
    assert disp == want_disp
    assert {k: (v[0], v[1], v[4], v[6], v[7]) for k, v in got.items()} == want


def test_empty_log(spark):
    made = B.Replay(calls_df(spark, []))
    assert made.states().collect() == made.history().collect() == made.dispositions().collect() == []
