"""Every query that SQL can express, over the smallest tables."""

import os

import pytest

from pagemill.plans import catalog
from tests.compare import connection, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    names, rows = rows_of(catalog.QUERIES[name](spark, SF))
    want_names, want = rows_of_sql(con, catalog.ORACLES[name])
    assert names == want_names
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 200
