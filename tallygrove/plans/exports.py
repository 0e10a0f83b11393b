"""Export tables, table profile and quick insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import bands
from tallygrove.functions.measures import (
    active_days, high, low, mean, mean_if, n_distinct, n_if, n_rows, ratio, total,
)
from tallygrove.operators import filters, groups, ranking
from tallygrove.schema import SALES_COLUMNS


def price_type(discounted: str, regular: str) -> Column:
    return F.when(F.col("discount_applied"), discounted).otherwise(regular)


def complete_dataset(df: DataFrame) -> DataFrame:
    return df.select(SALES_COLUMNS)


def sales_by_country(df: DataFrame) -> DataFrame:
    per = filters.sales_only(df).groupBy("country").agg(
        n_rows().alias("total_transactions"),
        total().alias("total_revenue"),
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
        n_distinct("product_name").alias("unique_products"),
    )
    return ranking.order_by(per, "-total_revenue", "country")


@ranking.listed("hour")
def hourly_sales(df: DataFrame) -> DataFrame:
    return filters.sales_only(df).groupBy(F.col("hour").cast("bigint").alias("hour")).agg(
        n_rows().alias("total_transactions"),
        total().alias("total_revenue"),
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
        n_distinct("receipt_number").alias("unique_receipts"),
    )


def discount_periods(df: DataFrame) -> DataFrame:
    per = filters.discounted(filters.sales_only(df)).groupBy("discount_period").agg(
        n_rows().alias("transactions"),
        total().alias("revenue"),
        mean().alias("avg_transaction"),
        n_distinct("customer_number").alias("customers"),
    )
    return ranking.order_by(per, "-revenue", "discount_period")


def regular_vs_discount(df: DataFrame) -> DataFrame:
    """Discounted against regular sales, with their share of all sales."""
    per = filters.sales_only(df).groupBy(price_type("Discounted", "Regular Price").alias("price_type")).agg(
        n_rows().alias("transactions"),
        total().alias("revenue"),
        mean().alias("avg_transaction"),
        n_distinct("customer_number").alias("customers"),
    )
    out = groups.share_of_total(per, "transactions", "transaction_percentage")
    return ranking.order_by(out, "-revenue", "price_type")


def age_by_country(df: DataFrame) -> DataFrame:
    rows = filters.known(filters.sales_only(df), "age")
    per = rows.groupBy("country", bands.age_band3().alias("age_group")).agg(
        n_rows().alias("total_transactions"),
        total().alias("total_revenue"),
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
        mean("age").alias("avg_age_in_group"),
    )
    return ranking.order_by(per, "country", "age_group")


def product_performance(df: DataFrame) -> DataFrame:
    per = filters.sales_only(df).groupBy("product_name").agg(
        n_rows().alias("total_transactions"),
        total().alias("total_revenue"),
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
        n_distinct("country").alias("countries_sold_in"),
        n_if("discount_applied").alias("discounted_sales"),
        mean_if("discount_applied").alias("avg_discounted_price"),
    )
    return ranking.order_by(per, "-total_revenue", "product_name")


def table_profile(df: DataFrame) -> DataFrame:
    """Size, distinct values, date range and revenue of the table in one pass."""
    return groups.overall(
        df,
        n_rows().alias("total_rows"),
        n_distinct("customer_number").alias("unique_customers"),
        n_distinct("product_id").alias("unique_product_ids"),
        n_distinct("product_name").alias("unique_products"),
        n_distinct("country").alias("unique_countries"),
        low("date").alias("earliest_date"),
        high("date").alias("latest_date"),
        total().alias("total_revenue"),
        mean().alias("avg_revenue"),
    )


def transaction_types(df: DataFrame) -> DataFrame:
    per = df.groupBy("transaction_desc").agg(n_rows().alias("count"))
    out = groups.share_of_total(per, "count", "percentage")
    return ranking.order_by(out, "-count", "transaction_desc")


def _best(df: DataFrame, key: str) -> DataFrame:
    return ranking.top_k(df.groupBy(key).agg(total().alias("revenue")), 1, "revenue", key)


def best_country(df: DataFrame) -> DataFrame:
    return _best(filters.sales_only(df), "country")


def best_product(df: DataFrame) -> DataFrame:
    return _best(filters.sales_only(df), "product_name")


def best_hour(df: DataFrame) -> DataFrame:
    return _best(filters.sales_only(df).withColumn("hour", F.col("hour").cast("bigint")), "hour")


def best_discount_period(df: DataFrame) -> DataFrame:
    return _best(filters.discounted(filters.sales_only(df)), "discount_period")


def key_metrics(df: DataFrame) -> DataFrame:
    out = filters.sales_only(df).agg(
        mean().alias("avg_transaction"),
        active_days().alias("days_of_operation"),
        total().alias("_revenue"),
    )
    return out.select(
        "avg_transaction",
        "days_of_operation",
        ratio("_revenue", "days_of_operation").alias("avg_daily_revenue"),
    )


def index_probe_counts(df: DataFrame) -> DataFrame:
    return filters.probe_counts(df)
