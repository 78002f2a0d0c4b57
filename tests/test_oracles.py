import os

import pytest

import __spark_entry__ as entry
from rudderql.operators import queries as operator_queries
from rudderql.plans import queries as plan_queries

from .compare import connect, differences

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.001")
QUERIES = plan_queries.queries() | operator_queries.queries()
SQL = plan_queries.oracle_sql() | operator_queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    if name not in SQL:
        assert QUERIES[name](spark, SF).count() > 0
    else:
        assert differences(spark, con, SF, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
