"""Plan-shape guards: no Cartesian products, top-k per group is limited
before the shuffle, and time filters reach the parquet scan."""

import pytest

from faultline.plans.registry import QUERIES, load_all

load_all()
# these run jobs while building (streams, checkpointed replay rounds, probes)
EAGER = ("stream_", "breaker_fold", "guarded_calls", "breaker_history", "resolve_error", "scan_stored", "merge_stored")
LAZY = sorted(n for n in QUERIES if not n.startswith(EAGER))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_product(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["related_errors", "retry_outcomes"])
def test_group_limit_before_shuffle(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", ["analytics_kpis", "top_errors", "trend_hour", "errors_recent"])
def test_time_filter_reaches_scan(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    scan = [line for line in p.split("\n") if "FileScan parquet" in line]
    assert scan and all("ts#" in line and ">= 20" in line for line in scan)


@pytest.mark.parametrize("name", LAZY)
def test_reads_the_driver_tables(spark, sf, name):
    """Every registered query scans the given parquet tables (its work grows with them)."""
    p = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in p and "parquet" in p
