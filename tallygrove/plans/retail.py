"""Retail overview: all types, receipts, weekdays, months, hours, age groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import bands, calendar
from tallygrove.functions.measures import high, low, mean, n_distinct, n_rows, total, total_int
from tallygrove.operators import filters, groups, ranking
from tallygrove.schema import AMOUNT


def overall_summary(df: DataFrame) -> DataFrame:
    return groups.overall(
        df,
        n_rows().alias("total_transactions"),
        n_distinct("customer_number").alias("unique_customers"),
        n_distinct("receipt_number").alias("unique_receipts"),
        n_distinct("product_id").alias("unique_products"),
        low("date").alias("start_date"),
        high("date").alias("end_date"),
        total().alias("total_revenue_sgd"),
        mean().alias("avg_amount_per_item"),
        mean("receipt_total_sgd").alias("avg_receipt_total"),
    )


def first_rows(df: DataFrame, k: int = 10) -> DataFrame:
    return ranking.earliest(df, k).select(
        "date", "customer_number", "receipt_number", "product_name", "units_sold",
        "unit_price_sgd", AMOUNT, "receipt_total_sgd", "day_of_week_text", "month_text",
    )


def _product_measures() -> list:
    return [
        total().alias("total_revenue"),
        total_int("units_sold").alias("total_units_sold"),
        n_rows().alias("transactions"),
        mean("unit_price_sgd").alias("avg_price"),
    ]


_PRODUCT_COLUMNS = ["product_name", "total_revenue", "total_units_sold", "transactions", "avg_price"]


def top5_products_all(df: DataFrame, k: int = 5) -> DataFrame:
    per = df.groupBy("product_id", "product_name").agg(*_product_measures())
    return ranking.top_k(per, k, "total_revenue", "product_id", "product_name").select(_PRODUCT_COLUMNS)


def weekday_receipts(df: DataFrame) -> DataFrame:
    return groups.by_labelled(
        df,
        "day_of_week_text",
        "day_of_week",
        calendar.weekday_text,
        total().alias("total_revenue"),
        n_distinct("receipt_number").alias("num_receipts"),
        mean("receipt_total_sgd").alias("avg_receipt_value"),
    )


def month_receipts(df: DataFrame) -> DataFrame:
    return groups.by_labelled(
        df,
        "month_text",
        "month",
        calendar.month_text,
        total().alias("total_revenue"),
        n_distinct("receipt_number").alias("num_receipts"),
        n_distinct("customer_number").alias("unique_customers"),
    )


def hour_receipts(df: DataFrame) -> DataFrame:
    per = df.groupBy(F.col("hour").cast("bigint").alias("hour")).agg(
        total().alias("total_revenue"),
        n_rows().alias("transactions"),
        mean("receipt_total_sgd").alias("avg_receipt_value"),
    )
    return ranking.order_by(per, "hour")


def age_group_sales(df: DataFrame) -> DataFrame:
    per = filters.known(df, "age").groupBy(bands.age_band3n().alias("age_group")).agg(
        n_rows().alias("total_transactions"),
        total().alias("total_revenue"),
        n_distinct("customer_number").alias("unique_customers"),
        n_distinct("receipt_number").alias("unique_receipts"),
        mean().alias("avg_transaction_value"),
        mean("receipt_total_sgd").alias("avg_receipt_value"),
        low("age").alias("min_age"),
        high("age").alias("max_age"),
        mean("age").alias("avg_age"),
    )
    return ranking.order_by(per, "age_group")


def age_group_share(df: DataFrame) -> DataFrame:
    """Share of the revenue of all sales with a known age."""
    per = filters.known(df, "age").groupBy(bands.age_band3n().alias("age_group")).agg(
        total().alias("total_revenue")
    )
    out = groups.share_of_total(per, "total_revenue", "revenue_percentage", None)
    return ranking.order_by(out, "age_group")


def top3_products_by_age(df: DataFrame, k: int = 3) -> DataFrame:
    """Best products of each age group, all groups in one query."""
    rows = filters.known(df, "age")
    per = rows.groupBy(bands.age_band3n().alias("age_group"), "product_id", "product_name").agg(
        *_product_measures()
    )
    out = ranking.top_k_per_group(per, "age_group", k, "total_revenue", "product_id", "product_name")
    return ranking.order_by(out.select("age_group", *_PRODUCT_COLUMNS), "age_group", "-total_revenue")
