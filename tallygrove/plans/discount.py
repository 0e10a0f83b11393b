"""Hours of the day and the effect of discount periods, sales only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.measures import (
    active_days, mean, n_distinct, n_if, n_rows, percent, ratio, total, total_if,
)
from tallygrove.operators import filters, groups, ranking
from tallygrove.plans.exports import hourly_sales


def _discounted(df: DataFrame) -> DataFrame:
    return filters.discounted(filters.sales_only(df))


def hour_extremes(df: DataFrame) -> DataFrame:
    """Best and worst hour by revenue, and the gap between them."""
    hours = hourly_sales.rows(df)
    out = ranking.best_and_worst(hours, "total_revenue", "hour")
    everything = ranking.Window.partitionBy()
    gap = F.max("total_revenue").over(everything) - F.min("total_revenue").over(everything)
    return out.withColumn("revenue_gap", gap.cast("decimal(38,2)"))


@ranking.listed("hour", "-revenue", "discount_period")
def hourly_discount(df: DataFrame) -> DataFrame:
    hour = F.col("hour").cast("bigint").alias("hour")
    return _discounted(df).groupBy(hour, "discount_period").agg(
        n_rows().alias("transactions"), total().alias("revenue")
    )


def top_discount_hours(df: DataFrame, k: int = 5) -> DataFrame:
    per = groups.rollup_again(hourly_discount.rows(df), "hour", total("revenue").alias("revenue"))
    return ranking.top_k(per, k, "revenue", "hour")


def discount_period_breakdown(df: DataFrame) -> DataFrame:
    per = _discounted(df).groupBy("discount_period").agg(
        n_rows().alias("transactions"),
        total().alias("revenue"),
        mean().alias("avg_transaction"),
        n_distinct("customer_number").alias("customers"),
        active_days().alias("active_days"),
    )
    out = per.withColumn("revenue_per_day", ratio("revenue", "active_days"))
    return ranking.order_by(out, "-revenue", "discount_period")


def discount_products(df: DataFrame, k: int = 15) -> DataFrame:
    per = _discounted(df).groupBy("product_name", "discount_period").agg(
        n_rows().alias("transactions"), total().alias("revenue"), mean().alias("avg_price")
    )
    return ranking.top_k(per, k, "revenue", "product_name", "discount_period")


def discount_countries(df: DataFrame) -> DataFrame:
    per = _discounted(df).groupBy("country").agg(
        n_rows().alias("discount_transactions"),
        total().alias("discount_revenue"),
        mean().alias("avg_discount_price"),
        n_distinct("customer_number").alias("discount_customers"),
    )
    return ranking.order_by(per, "-discount_revenue", "country")


def yearly_discounts(df: DataFrame, min_year: int = 2020) -> DataFrame:
    rows = filters.from_year(_discounted(df), min_year)
    per = rows.groupBy(F.col("year").cast("bigint").alias("year")).agg(
        n_rows().alias("discount_transactions"),
        total().alias("discount_revenue"),
        n_distinct("customer_number").alias("discount_customers"),
    )
    return ranking.order_by(per, "year")


def discount_impact(df: DataFrame) -> DataFrame:
    """How many sales were discounted, what they brought, and what they would
    have brought at the average regular amount. No row unless there are both
    kinds of sales."""
    yes = F.col("discount_applied")
    out = filters.sales_only(df).agg(
        n_if(yes).alias("discount_transactions"),
        n_if(~yes).alias("regular_transactions"),
        total_if(yes).alias("discount_revenue"),
        total_if(~yes).alias("regular_revenue"),
    )
    out = out.filter((F.col("discount_transactions") > 0) & (F.col("regular_transactions") > 0))
    everything = F.col("discount_revenue") + F.col("regular_revenue")
    sales = F.col("discount_transactions") + F.col("regular_transactions")
    avg_regular = ratio("regular_revenue", "regular_transactions")
    return out.select(
        "discount_transactions",
        "regular_transactions",
        "discount_revenue",
        "regular_revenue",
        percent("discount_transactions", sales, None).alias("discount_adoption_pct"),
        percent("discount_revenue", everything, None).alias("discount_revenue_pct"),
        (
            F.col("discount_transactions").cast("double") * avg_regular
            - F.col("discount_revenue").cast("double")
        ).alias("revenue_sacrifice"),
    )


def best_discount_efficiency(df: DataFrame) -> DataFrame:
    """The period with the highest revenue per active day."""
    per = _discounted(df).groupBy("discount_period").agg(
        total().alias("revenue"), active_days().alias("active_days")
    )
    per = per.withColumn("revenue_per_day", ratio("revenue", "active_days"))
    return ranking.row_at_max(per, "revenue_per_day", "discount_period")
