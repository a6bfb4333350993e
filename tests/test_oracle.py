"""Every registered query against its SQL on the smallest tables."""

import pytest

from cladeframe import plans
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = plans.all_queries(), plans.all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF_DIR, QUERIES[name], SQL.get(name))
    assert ok, message


def test_sql_covers_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(set(QUERIES) - set(SQL)) <= 3
