import pytest

import __spark_entry__ as entry
from suite import oracle
from suite.compare import connect, differences
from suite.queries import QUERIES

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[0] == "domain" and out.count() > 5


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, small, con, name):
    assert not differences(QUERIES[name](spark, small), con, SQL[name])
