"""Persisted maintenance, repeated sequence numbers, registry keys and the checkpoint folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.operators import maintenance as M
from faultline.sources import tables as T


def stored(spark, path):
    return spark.read.parquet(path).drop("created_date")


def test_a_purge_leaves_only_the_kept_rows(spark, sf, tmp_path):
    err = T.errors(spark, sf)
    path = str(tmp_path / "errors")
    M.write_partitioned(err, path)
    kept = M.retention_purge(stored(spark, path), dt.datetime(2024, 1, 31), days=10, status="all")
    want = kept.count()
    assert 0 < want < err.count()
    assert M.write_partitioned(kept, path, whole=True)
    assert stored(spark, path).count() == want


def test_resolving_one_error_rewrites_one_day(spark, sf, tmp_path):
    err = T.errors(spark, sf)
    path = str(tmp_path / "errors")
    M.write_partitioned(err, path)
    table = stored(spark, path)
    ident = table.where("resolved_at is null and not is_resolved").agg(F.min("id")).first()[0]
    day = M.touched_days(table, F.col("id") == ident)
    assert day.select(F.to_date("created_at")).distinct().count() == 1
    resolved = table.where("resolved_at is not null").count()
    changed = M.resolve_error(day, ident, dt.datetime(2024, 1, 31))
    assert M.write_partitioned(changed.checkpoint(), path) == []
    after = stored(spark, path)
    assert after.count() == err.count()
    assert after.where(F.col("id") == ident).first()["is_resolved"]
    assert after.where("resolved_at is not null").count() == resolved + 1


def test_breakers_may_share_sequence_numbers(spark):
    from faultline.config import BreakerConfig
    from faultline.operators.breaker import breaker_fold

    start = dt.datetime(2024, 1, 1)
    logs = {"a": "fffosofffssf", "b": "sfffffoosffs"}
    rows = [
        (i, start + dt.timedelta(seconds=25 * i), svc, "op", c != "f") for svc, log in logs.items() for i, c in enumerate(log)
    ]
    schema = "seq long, ts timestamp_ntz, service string, operation string, ok boolean"
    cfg = BreakerConfig(failure_threshold=2, recovery_timeout_s=40)
    both = {r.service: r for r in breaker_fold(spark.createDataFrame(rows, schema), cfg).collect()}
    for svc in logs:
        alone = breaker_fold(spark.createDataFrame([r for r in rows if r[2] == svc], schema), cfg).collect()
        assert [both[svc]] == alone


def test_a_key_registered_twice_multiplies_no_call(spark):
    from faultline.operators.joins import fallback_resolution

    calls = spark.createDataFrame([(1, "s", "o"), (2, "s", None), (3, "x", "o")], "id long, service string, operation string")
    registry = spark.createDataFrame([("s.o", "b"), ("s.o", "a"), ("s", "c"), ("s", "c")], "key string, strategy string")
    out = {r.id: (r.fallback, r.fallback_source) for r in fallback_resolution(calls, registry, F.lit(True)).collect()}
    assert len(out) == 3 and out[1] == ("a", "operation") and out[2][0] == "c" and out[3][1] == "default"


def test_an_unset_checkpoint_folder_is_an_error_on_a_cluster():
    from faultline.session import ensure_checkpoint_dir

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.path = path

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("yarn", "spark://h:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(Session(master))
    assert ensure_checkpoint_dir(Session("local[4]"))


def test_a_struct_key_masks_null_leaves(spark):
    from faultline.functions.nested import mask_nested

    df = spark.createDataFrame([((None, "x"),)], "v struct<password:string,note:string>")
    assert df.select(mask_nested(F.col("v"), df.schema["v"].dataType).alias("v")).first().v.password is not None


def test_a_missing_id_is_an_error(spark):
    from faultline.operators.filters import by_id_or_fail

    rows = spark.range(3)
    assert by_id_or_fail(rows, 2).count() == 1
    with pytest.raises(LookupError):
        by_id_or_fail(rows, 7)
