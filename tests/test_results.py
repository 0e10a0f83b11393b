"""Every query against its SQL in an independent engine."""

import pytest

import __spark_entry__ as driver
from compare import connect, difference

QUERIES = {k: v for k, v in driver.queries().items() if k not in driver.LLM_QUERIES}
SQL = {k: v for k, v in driver.oracle_sql().items() if k not in driver.LLM_QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns[0] == "month" and out.count() > 0


def test_sales_build_without_broadcast(spark, sf_dir, con):
    """Sort-merge joins, as with tables too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = QUERIES["scan_sales"](spark, sf_dir)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert difference(df, con, SQL["scan_sales"]) is None
        assert difference(QUERIES["geo_enriched"](spark, sf_dir), con, SQL["geo_enriched"]) is None
    finally:
        spark.conf.set(key, before)
