"""Stored tables: schema evolution, pruning by day, malformed lines, merges and writes that break off."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from faultline.operators.joins import error_occurrences
from faultline.sources import stored as S
from faultline.sources import tables as T

COLS = ["id", "error_id", "message", "occurrence_count", "first_occurred_at", "last_occurred_at", "meta", "ip_address"]


def rows(df, cols=COLS):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def err(spark, *given):
    base = {"message": "m", "occurrence_count": 1, "meta": '{"a":1}', "ip_address": "10.0.0.1"}
    made = [base | {"id": i, "error_id": e, "first_occurred_at": t, "last_occurred_at": t, "created_at": t} | more for i, e, t, more in given]
    names = [f.split()[0] for f in S.ERRORS.split(", ")]
    return spark.createDataFrame([[m.get(n) for n in names] for m in made], S.ERRORS)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_round_trip_and_pruning(spark, sf, tmp_path):
    table = S.errors_table(spark, str(tmp_path / "errors"))
    assert table.read().collect() == [] and table.version() == 0
    want = S.as_schema(T.stored_errors(spark, sf), S.ERRORS)
    days = table.write(want)
    assert rows(table.read(), want.columns) == rows(want, want.columns)
    part = table.read(since="2024-01-05", until="2024-01-06")
    assert rows(part) == rows(want.where(F.to_date("created_at").between("2024-01-05", "2024-01-06")))
    assert len(part.inputFiles()) < len(table.read().inputFiles()) and all("day=2024-01-0" in f for f in part.inputFiles())
    assert {f.split("day=")[1][:10] for f in table.read().inputFiles()} == set(days)


def test_older_and_newer_files(spark, tmp_path):
    path = str(tmp_path / "t")
    old = S.StoredTable(spark, path, "id long, error_id string, created_at timestamp_ntz, gone string", lambda: F.col("created_at"))
    old.write(spark.createDataFrame([(1, "a", at(1), "x")], old.schema))
    table = S.StoredTable(spark, path, S.ERRORS, lambda: F.col("created_at"))
    table.write(err(spark, (2, "b", at(2), {})))
    assert rows(table.read(), ["id", "error_id", "meta"]) == [(1, "a", None), (2, "b", '{"a":1}')]


def test_merge_rewrites_touched_days(spark, tmp_path):
    table = S.errors_table(spark, str(tmp_path / "t"))
    table.write(err(spark, (1, "a", at(1), {}), (2, "b", at(2), {"message": "kept"}), (3, "c", at(3), {}), (4, None, at(3), {})))
    before = table.manifest()
    batch = err(spark, (9, "b", at(4), {"message": "new"}), (10, "b", at(5), {}), (11, "d", at(4, 2), {}), (12, "c", at(2), {}))
    assert S.merge_errors(table, batch) == ["2024-01-02", "2024-01-03", "2024-01-04"]
    after = table.manifest()
    assert after["2024-01-01"] == before["2024-01-01"]  # not written again
    got = {r.error_id: (r.id, r.message, r.occurrence_count, r.first_occurred_at, r.last_occurred_at) for r in table.read().collect()}
    assert got == {
        "a": (1, "m", 1, at(1), at(1)), "b": (2, "kept", 3, at(2), at(5)), "c": (3, "m", 2, at(2), at(3)),
        "d": (11, "m", 1, at(4, 2), at(4, 2)), None: (4, "m", 1, at(3), at(3)),
    }
    one = err(spark, (20, "d", at(9), {}))
    assert S.merge_errors(table, one) == ["2024-01-04"]


def test_merges_equal_one_roll_up(spark, sf, tmp_path):
    source = S.as_schema(T.stored_errors(spark, sf).withColumn("occurrence_count", F.lit(1)), S.ERRORS)
    table = S.errors_table(spark, str(tmp_path / "t"))
    for i in range(3):
        S.merge_errors(table, source.where(F.col("id") % 3 == i))
    cols = ["error_id", "id", "occurrence_count", "first_occurred_at", "last_occurred_at"]
    # the stored id is that of the batch that first named the error
    pick = [c for c in cols if c != "id"]
    assert rows(table.read(), pick) == rows(error_occurrences(T.errors(spark, sf)), pick)


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    table = S.errors_table(spark, str(tmp_path / "t"))
    table.write(err(spark, (1, "a", at(1), {}), (2, "b", at(2), {})))
    want = rows(table.read())
    with monkeypatch.context() as m:
        m.setattr(S.StoredTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.write(err(spark, (3, "c", at(1), {})), whole=True)
    assert rows(table.read()) == want and table.version() == 1
    table.write(err(spark, (3, "c", at(1), {})), whole=True)  # the purge goes through in one step
    assert [r[0] for r in rows(table.read())] == [3] and list(table.manifest()) == ["2024-01-01"]
    table.vacuum(keep=1)
    assert [r[0] for r in rows(table.read())] == [3]


def test_two_writers(spark, tmp_path):
    table = S.errors_table(spark, str(tmp_path / "t"))
    table.write(err(spark, (1, "a", at(1), {})))
    with pytest.raises(RuntimeError, match="another job"):
        table._commit(1, {})
    assert table.change(["2024-01-01"], lambda df: df.where("id > 1")) == []
    assert table.read().collect() == []


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "lines.json"
    good = {"id": 1, "error_id": "e", "status_code": 500, "created_at": "2024-01-01T00:00:00", "other": [1]}
    path.write_text("\n".join([json.dumps(good), "{broken", "", json.dumps({"id": "x"}), "[1]", json.dumps({"id": 2})]))
    ok, bad = S.read_json_lines(spark, str(path))
    assert sorted(r.id for r in ok.collect()) == [1, 2] and ok.schema == spark.createDataFrame([], S.ERRORS).schema
    assert sorted(r.line for r in bad.collect()) == ["[1]", '{"id": "x"}', "{broken"] and bad.first().file.endswith("lines.json")


def test_trends_and_breakers(spark, sf, tmp_path):
    from faultline.plans.q_sources import trend_table

    trends = S.trends_table(spark, str(tmp_path / "trends"))
    trends.write(trend_table(spark, sf))
    cols = ["date", "error_code", "status_code", "count"]
    assert rows(trends.read(since="2024-01-03", until="2024-01-03"), cols) == rows(trend_table(spark, sf).where("date = '2024-01-03'"), cols)
    breakers = S.breakers_table(spark, str(tmp_path / "breakers"))
    breakers.write(T.breakers(spark, sf))
    cols = ["id", "service", "operation", "state", "failure_count", "next_attempt_at"]
    assert rows(breakers.read(), cols) == rows(T.breakers(spark, sf), cols)
