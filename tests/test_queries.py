"""Every registered query with an oracle agrees with DuckDB, row by row and type by type."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from compare import connect, differences

from tidewatch.catalog import registered

QUERIES = registered()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.oracle])
def test_matches_sql(spark, sf, con, name):
    assert differences(QUERIES[name].build(spark, sf), con, QUERIES[name].oracle) == []


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.oracle])
def test_returns_rows(spark, sf, name):
    assert QUERIES[name].build(spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
