"""What the plans must look like to hold at scale."""

import re

import pytest

from tallygrove.operators import order_stats
from tallygrove.plans import api, discount, retail, summary
from tallygrove.plans.queries import QUERIES
from tallygrove.plans.registry import REPORTS
from tallygrove.schema import SALES_COLUMNS
from tallygrove.sources.star import report_table, stored_sales


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    """The executed plan after adaptive execution, without the initial one."""
    return re.sub(r"== Initial Plan ==.*?(?=\n\s*(?::|\+-) *==|\Z)", "", plan(df, run=True), flags=re.S)


@pytest.fixture(scope="module")
def df(spark, sf_dir):
    return report_table(spark, sf_dir)


def test_deciles_shuffle_no_rows(spark, sf_dir):
    rows = stored_sales(spark, sf_dir).select(SALES_COLUMNS)
    assert "Exchange" not in plan(order_stats.with_decile(rows))


def test_value_transactions_has_no_single_partition_below_the_aggregate(df):
    text = plan(api.value_transactions(df))
    below = text[text.rindex("HashAggregate(keys=") :]
    assert "SinglePartition" not in below


def test_one_day_reads_one_month(df):
    text = plan(api.sales_by_date(df, "1996-07-04"))
    assert re.search(r"PartitionFilters: \[[^\]]*sale_month#\d+ >= 1996-07-01", text)
    assert "GreaterThanOrEqual(date" in text


def test_city_lookup_shuffles_no_sales(spark, sf_dir):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = final(QUERIES["geo_enriched"](spark, sf_dir))
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_ranks_see_no_single_partition_of_products(spark, sf_dir):
    text = final(QUERIES["rank_with_gaps"](spark, sf_dir))
    below = [part.split("\n")[0:12] for part in text.split("SinglePartition")[1:]]
    assert all(any("_range" in line for line in part) for part in below)


def test_first_pages_read_the_newest_months(df):
    assert re.search(r"PartitionFilters: \[[^\]]*sale_month#\d+ >= \d{4}-\d\d-01", plan(api.sales_page(df)))
    assert re.search(r"PartitionFilters: \[[^\]]*sale_month#\d+ <= \d{4}-\d\d-01", plan(retail.first_rows(df)))


def test_years_prune_partitions(df):
    text = plan(summary.product_country_recent(df, min_year=1998))
    assert re.search(r"PartitionFilters: \[[^\]]*sale_month#\d+ >= 1998-01-01", text)


def test_discount_reports_read_three_months_of_the_year(df):
    text = plan(discount.discount_countries(df))
    assert re.search(r"PartitionFilters: \[[^\]]*month\(sale_month#\d+\) IN \(1,11,12\)", text)
    assert "Join" not in text


def test_scans_read_needed_columns_only(df):
    text = plan(api.hourly_distribution(df))
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert schema.count(":") == 3


def test_sale_filter_is_pushed_down(df):
    assert "EqualTo(transaction_desc,Product Sale)" in plan(summary.sales_only_by_country(df))


@pytest.mark.parametrize(
    "report", ["daily_highlights", "period_highlights", "top5_product_years", "age_share_highlights", "hour_extremes"]
)
def test_second_level_reports_scan_once(df, report):
    assert plan(REPORTS[report](df)).count("FileScan") == 1


def test_matrix_aggregates_once(df):
    text = final(summary.product_country_matrix(df, min_year=1998))
    assert "ReusedExchange" in text


def test_top_per_group_limits_before_the_shuffle(df):
    assert re.search(r"WindowGroupLimit .*Partial", plan(retail.top3_products_by_age(df)))


def test_top_k_keeps_k_rows_per_task(df):
    assert "TakeOrderedAndProject(limit=20" in plan(api.top_products(df))


@pytest.mark.parametrize("name", sorted(set(REPORTS) - {"sales_by_date", "customer_totals", "customer_recent", "receipt_items"}))
def test_no_python_and_no_nested_loops(df, name):
    text = plan(REPORTS[name](df))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text
