"""Every graph query against its SQL."""

import pytest

from tests.oracle import compare, connect
from wayframe.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_sql(spark, con, name):
    compare(Q.QUERIES[name](spark, SF), con, Q.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["name", "key", "value"] and df.count() > 0
    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
