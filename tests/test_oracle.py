"""Every query with a SQL counterpart gives the same rows as DuckDB on the small tables."""

import pytest

from compare import connect, difference
from lopside.suite.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, DATA), con, SQL[name]) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
