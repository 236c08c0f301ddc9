"""Every registered query against its DuckDB twin (the driver's gate), at sf0.001."""

import pytest

from faultline.plans.check import compare, duck_connect
from faultline.plans.registry import ORACLE, QUERIES, load_all

load_all()
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con(sf):
    return duck_connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, sf, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], sf)
    assert r["ok"], r


def test_every_query_registered_with_entry():
    import __spark_entry__ as E

    assert set(QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 1
    assert "total_errors" in df.columns
