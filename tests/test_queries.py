"""Every query that SQL can express, against DuckDB; the others run and give rows."""

import pytest

from casefile.plans.catalog import QUERIES, SQL
from tests.oracle import assert_equal, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert_equal(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["fused_class", "status", "routing", "n", "mean_score"]
