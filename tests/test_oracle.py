"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

from pathlib import Path

import pytest
from oracle import compare, views

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
QUERIES, SQL = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(k for k in set(QUERIES) - set(SQL) if ".llm." not in QUERIES[k].__module__))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert E.entry(spark).limit(1).count() == 1
