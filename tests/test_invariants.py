"""Invariants over the driver tables."""

from pyspark.sql import functions as F

from faultline.functions import redact as RD
from faultline.operators import aggregates as AG
from faultline.sources import tables as T

AS_OF = T.AS_OF


def test_percentages_sum_to_100(spark, sf):
    d = AG.status_distribution(T.errors(spark, sf), AS_OF, 30)
    assert abs(d.agg(F.sum("percentage")).first()[0] - 100.0) < 0.1


def test_redaction_idempotent(spark, sf):
    d = T.documents(spark, sf).select(RD.redact(F.col("text")).alias("t"))
    twice = d.select(F.col("t"), RD.redact(F.col("t")).alias("t2"))
    assert twice.filter(F.col("t") != F.col("t2")).count() == 0


def test_secret_mask_idempotent(spark, sf):
    d = T.contact_lines(spark, sf).select(RD.mask_secrets(F.col("text")).alias("t"))
    assert d.filter(F.col("t") != RD.mask_secrets(F.col("t"))).count() == 0


def test_related_errors_with_a_hot_endpoint(spark):
    """A third of the rows on one endpoint: the bounded candidate join still
    returns, for every error, the 5 newest others (checked by brute force)."""
    import datetime as dt

    from faultline.operators.joins import related_errors

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 == 0 else f"u{i % 7}", t0 + dt.timedelta(seconds=(i * 37) % 500)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, request_url string, created_at timestamp_ntz")
    got = {(r.id, r.rank): r.related_id for r in related_errors(df, 5).collect()}
    want = {}
    for i, u, ts in rows:
        others = sorted((r for r in rows if r[1] == u and r[0] != i), key=lambda r: (r[2], r[0]), reverse=True)[:5]
        for k, r in enumerate(others, start=1):
            want[(i, k)] = r[0]
    assert got == want
