"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

from compare import connect, differences
from panelforge.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_query_agrees_with_sql(spark, db, name):
    q = REGISTRY[name]
    assert differences(q.run(spark, FOLDER), db, q.sql) is None


def test_comparison_notices_a_wrong_value(spark, db):
    q = REGISTRY["positive_share"]
    assert differences(q.run(spark, FOLDER), db, "SELECT 0.5::DOUBLE AS positive_share") is not None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
