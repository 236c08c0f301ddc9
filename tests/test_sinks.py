"""Sinks and paging helpers: CSV / JSON writers, partitioned table writes,
keyset paging."""

import os
import tempfile

from pyspark.sql import functions as F

from faultline.operators import filters as P
from faultline.operators import maintenance as D
from faultline.operators import shapes as SH
from faultline.sources import tables as T

AS_OF = T.AS_OF


def _scratch(spark):
    base = spark.sparkContext.getCheckpointDir().replace("file:", "")
    return tempfile.mkdtemp(prefix="sink-", dir=base)


def test_csv_export_round_trip(spark, sf):
    rows = SH.export_errors_csv_rows(SH.export_errors(T.errors(spark, sf), AS_OF, 7))
    path = os.path.join(_scratch(spark), "errors_csv")
    SH.write_csv(rows, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == rows.columns
    assert back.count() == rows.count()
    assert set(r["Resolved"] for r in back.select("Resolved").distinct().collect()) <= {"Yes", "No"}


def test_json_export_round_trip(spark, sf):
    rows = SH.export_errors(T.errors(spark, sf), AS_OF, 7)
    path = os.path.join(_scratch(spark), "errors_json")
    SH.write_json(rows, path)
    back = spark.read.json(path)
    assert back.count() == rows.count()


def test_partitioned_write_overwrites_only_touched_days(spark, sf):
    err = T.errors(spark, sf)
    path = os.path.join(_scratch(spark), "errors_table")
    D.write_partitioned(err, path)
    days = spark.read.parquet(path).select("created_date").distinct().count()
    # rewrite one day with a purge applied: the other days stay as they were
    one_day = err.filter(F.to_date("created_at") == F.lit("2024-01-02").cast("date"))
    D.write_partitioned(one_day.filter(F.col("is_resolved")), path)
    back = spark.read.parquet(path)
    assert back.select("created_date").distinct().count() == days
    assert back.filter(F.col("created_date") == "2024-01-02").filter(~F.col("is_resolved")).count() == 0
    assert back.filter(F.col("created_date") == "2024-01-03").count() == err.filter(F.to_date("created_at") == F.lit("2024-01-03").cast("date")).count()


def test_keyset_paging_matches_offset_paging(spark, sf):
    err = T.errors(spark, sf)
    first = P.page(err, {"status": "unresolved"}, page_no=1, per_page=10).collect()
    second = P.page(err, {"status": "unresolved"}, page_no=2, per_page=10).collect()
    last = first[-1]
    keyset = P.page_after(err, last["created_at"], last["id"], {"status": "unresolved"}, per_page=10).collect()
    assert [r["id"] for r in keyset] == [r["id"] for r in second]


def test_bulk_delete_list_and_frame(spark, sf):
    err = T.errors(spark, sf)
    ids = [r["id"] for r in err.orderBy("id").limit(3).collect()]
    assert D.bulk_delete(err, ids).count() == err.count() - 3
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    assert D.bulk_delete(err, frame).count() == err.count() - 3
