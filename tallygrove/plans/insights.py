"""Key insights, sales only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import bands
from tallygrove.functions.measures import high, low, mean, n_distinct, n_rows, total
from tallygrove.operators import filters, groups, order_stats, ranking
from tallygrove.schema import AMOUNT


def age_share_sale(df: DataFrame) -> DataFrame:
    """Sales per age band as a share of all sales; those without an age count in
    the total but have no row."""
    unknown = bands.AGE_BANDS_3[-1]
    per = filters.sales_only(df).groupBy(bands.age_band3().alias("age_group")).agg(
        n_rows().alias("transactions"), total().alias("revenue")
    )
    out = groups.share_of_total(per, "transactions", "percentage")
    return ranking.order_by(out.filter(F.col("age_group") != unknown), "-transactions", "age_group")


def top5_recent_products(df: DataFrame, min_year: int = 2020, k: int = 5) -> DataFrame:
    rows = filters.from_year(filters.sales_only(df), min_year)
    per = rows.groupBy("product_name").agg(total().alias("revenue"), n_rows().alias("transactions"))
    return ranking.top_k(per, k, "revenue", "product_name")


def country_ranking(df: DataFrame) -> DataFrame:
    per = filters.sales_only(df).groupBy("country").agg(
        total().alias("revenue"),
        n_rows().alias("transactions"),
        n_distinct("customer_number").alias("customers"),
    )
    return ranking.order_by(ranking.with_position(per, "revenue", "country"), "position")


def top3_months(df: DataFrame, k: int = 3) -> DataFrame:
    per = filters.sales_only(df).groupBy("month_text", "month").agg(
        total().alias("revenue"), n_rows().alias("transactions")
    )
    return ranking.top_k(per, k, "revenue", "month").drop("month")


def value_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """Average, smallest, largest and median sale. The median is exact, found by
    counting passes; ``approx`` takes a sketch in the same pass instead."""
    rows = filters.sales_only(df).select(AMOUNT)
    figures = [
        mean().alias("avg_transaction"),
        low(AMOUNT).alias("min_transaction"),
        high(AMOUNT).alias("max_transaction"),
    ]
    if approx:
        middle = F.percentile_approx(F.col(AMOUNT).cast("double"), 0.5)
        return rows.agg(*figures, middle.alias("median_transaction"))
    middle = F.lit(order_stats.median(rows)).cast("double")
    return rows.agg(*figures).withColumn("median_transaction", middle)


def yearly_growth(df: DataFrame, min_year: int = 2020) -> DataFrame:
    rows = filters.from_year(filters.sales_only(df), min_year)
    per = rows.groupBy(F.col("year").cast("bigint").alias("year")).agg(
        total().alias("revenue"), n_distinct("customer_number").alias("customers")
    )
    return ranking.order_by(per, "year")


def kpis(df: DataFrame) -> DataFrame:
    return filters.sales_only(df).agg(
        n_rows().alias("total_sales"),
        total().alias("total_revenue"),
        n_distinct("customer_number").alias("total_customers"),
        n_distinct("product_name").alias("total_products"),
        n_distinct("country").alias("total_countries"),
    )
