"""Smaller reports and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import calendar
from tallygrove.functions.measures import mean, n_distinct, n_if, n_rows, total
from tallygrove.operators import filters, groups, ranking
from tallygrove.schema import AMOUNT, ROW_ID


def _average_total_count() -> list:
    return [
        mean().alias("avg_sales"),
        total().alias("total_sales"),
        n_rows().alias("count"),
    ]


def weekday_stats(df: DataFrame) -> DataFrame:
    return groups.by_labelled(df, "day_of_week_text", "day_of_week", calendar.weekday_text, *_average_total_count())


def month_stats(df: DataFrame) -> DataFrame:
    return groups.by_labelled(df, "month_text", "month", calendar.month_text, *_average_total_count())


def top5_rows(df: DataFrame, k: int = 5) -> DataFrame:
    return ranking.top_k(df, k, AMOUNT, *ROW_ID).select(
        "date", AMOUNT, "day_of_week_text", "month_text"
    )


def sales_by_income(df: DataFrame) -> DataFrame:
    per = df.groupBy("customer_number", "income").agg(total().alias("total_sales"))
    return ranking.order_by(per, "-income", "-total_sales", "customer_number")


def older_than_30(df: DataFrame, k: int = 5) -> DataFrame:
    return ranking.sample(filters.above(df, "age", 30), k)


def discount_health(df: DataFrame, enough: int = 3_000_000) -> DataFrame:
    """Size check of the table; enough rows means more than ``enough``."""
    out = df.agg(
        n_rows().alias("total_records"),
        n_distinct("customer_number").alias("customers"),
        n_distinct("product_name").alias("products"),
        n_distinct("country").alias("countries"),
        n_if("discount_applied").alias("discount_transactions"),
    )
    return out.withColumn("sufficient_data", F.col("total_records") > enough)


def discount_counts(df: DataFrame) -> DataFrame:
    per = filters.discounted(df).groupBy("discount_period").agg(n_rows().alias("count"))
    return ranking.order_by(per, "-count", "discount_period")


def projected_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "date", "product_name", "units_sold", "unit_price_sgd", AMOUNT,
        "receipt_total_sgd", "country", "city", "income",
    )
