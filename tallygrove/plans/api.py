"""Parameterised reports on sales, customers and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import bands, calendar
from tallygrove.functions.measures import (
    growth_pct, high, low, mean, n_distinct, n_rows, ratio, total, total_int,
)
from tallygrove.operators import filters, groups, order_stats, ranking
from tallygrove.operators.filters import DateLike
from tallygrove.schema import AMOUNT, ROW_ID, SALES_COLUMNS


def sales_page(
    df: DataFrame,
    page: int = 1,
    page_size: int = 50,
    start_date: DateLike | None = None,
    end_date: DateLike | None = None,
    product_id: str | None = None,
    customer_id: str | None = None,
    min_age: int | None = None,
    max_age: int | None = None,
) -> DataFrame:
    """One page of the matching sales, newest first."""
    rows = filters.filter_sales(
        df, start_date, end_date, product_id, customer_id, min_age, max_age
    )
    return ranking.page(rows, page, page_size).select(SALES_COLUMNS)


def sales_page_total(df: DataFrame, **conditions) -> DataFrame:
    """Number of sales the same conditions match."""
    return filters.filter_sales(df, **conditions).agg(n_rows().alias("total_records"))


def customers(df: DataFrame) -> DataFrame:
    """Distinct customers with age and country."""
    return ranking.order_by(groups.distinct_rows(df, ["customer_id", "age", "country"]), "customer_id")


def customers_summary(df: DataFrame) -> DataFrame:
    per = df.groupBy("customer_id", "age", "country").agg(
        n_rows().alias("total_sales"), total().alias("total_amount")
    )
    return ranking.order_by(per, "customer_id")


def sales_summary(df: DataFrame) -> DataFrame:
    """Totals and date range of the whole table."""
    return groups.overall(
        df,
        n_rows().alias("total_records"),
        total().alias("total_revenue"),
        n_distinct("customer_id").alias("unique_customers"),
        n_distinct("receipt_number").alias("unique_receipts"),
        low("date").alias("date_start"),
        high("date").alias("date_end"),
    )


def summary_top_products(df: DataFrame, k: int = 10) -> DataFrame:
    per = df.groupBy("product_id", "product_name").agg(
        total_int("units_sold").alias("total_units"),
        total().alias("total_revenue"),
        mean("unit_price_sgd").alias("avg_price"),
    )
    return ranking.top_k(per, k, "total_revenue", "product_id", "product_name")


def top_products(df: DataFrame, k: int = 20) -> DataFrame:
    """Best-selling products by revenue."""
    per = df.groupBy("product_id", "product_name").agg(
        n_rows().alias("transaction_count"),
        total_int("units_sold").alias("total_units_sold"),
        total().alias("total_revenue"),
        mean("unit_price_sgd").alias("avg_price"),
    )
    return ranking.top_k(per, k, "total_revenue", "product_id", "product_name")


def monthly_trends(df: DataFrame) -> DataFrame:
    """Revenue and customers per month against the month before."""
    months = df.groupBy(calendar.month_start("date").alias("month")).agg(
        total().alias("revenue"), n_distinct("customer_id").alias("customers")
    )
    out = ranking.with_previous(
        months, "month", {"revenue": "prev_revenue", "customers": "prev_customers"}
    )
    return ranking.order_by(
        out.withColumns(
            {
                "revenue_change_pct": growth_pct("revenue", "prev_revenue"),
                "customer_change_pct": growth_pct("customers", "prev_customers"),
            }
        ),
        "month",
    )


def customer_demographics(df: DataFrame) -> DataFrame:
    """Spending per age band and gender. The average income is taken over sales,
    not over customers."""
    per = df.groupBy(bands.age_band6().alias("age_group"), "gender").agg(
        n_distinct("customer_id").alias("customer_count"),
        mean("income").alias("avg_income"),
        total().alias("total_spent"),
    )
    out = per.withColumn("avg_spent_per_customer", ratio("total_spent", "customer_count"))
    return ranking.order_by(out, "age_group", "gender")


def hourly_distribution(df: DataFrame) -> DataFrame:
    per = df.groupBy(F.hour("date").cast("bigint").alias("hour_of_day")).agg(
        n_rows().alias("transaction_count"),
        total().alias("total_revenue"),
        n_distinct("customer_id").alias("unique_customers"),
    )
    return ranking.order_by(per, "hour_of_day")


def geographic_distribution(df: DataFrame, k: int = 15) -> DataFrame:
    """Countries ranked by revenue, the first k."""
    per = df.groupBy("country").agg(
        n_rows().alias("transactions"),
        n_distinct("customer_id").alias("customers"),
        total().alias("total_revenue"),
    )
    return ranking.top_ranked(per, k, "total_revenue", "country", "revenue_rank")


def value_transactions(df: DataFrame) -> DataFrame:
    """The tenth of sales with the highest amounts against the lowest tenth."""
    # sales of one customer at one amount are alike for this report, so the
    # customer is all it takes to order sales of the same amount
    rows = df.select("customer_id", "age", AMOUNT)
    grouped = order_stats.with_outer_deciles(rows, AMOUNT, ["customer_id"])
    group = F.col("value_group")
    outer = group != 2
    per = grouped.groupBy("value_group").agg(
        n_rows().alias("transaction_count"),
        n_distinct(F.when(outer, F.col("customer_id"))).alias("unique_customers"),
        mean("age").alias("avg_customer_age"),
        mean().alias("avg_transaction_value"),
        total().alias("total_revenue"),
        F.count(AMOUNT).alias("_n"),
    )
    own = ratio("total_revenue", "transaction_count")
    per = groups.ratio_to_overall(per, own, "total_revenue", "_n", "relative_to_average")
    segment = F.when(group == 1, "Bottom 10%").otherwise("Top 10%").alias("value_segment")
    out = per.filter(outer).select(segment, *[c for c in per.columns if c not in ("value_group", "_n")])
    return ranking.order_by(out, "value_segment")


def _per_segment(df: DataFrame, segment: Column, labels: list[str]) -> DataFrame:
    per = df.groupBy(segment.alias("income_segment")).agg(
        n_distinct("customer_id").alias("customer_count"),
        n_rows().alias("transaction_count"),
        total().alias("total_revenue"),
        mean().alias("avg_transaction_value"),
    )
    out = per.withColumn("avg_spent_per_customer", ratio("total_revenue", "customer_count"))
    return ranking.order_by_segment(out, "income_segment", labels)


def income_levels(df: DataFrame) -> DataFrame:
    """Spending per income segment; without an income column, per career stage
    guessed from the age."""
    if "income" not in df.columns:
        return income_levels_by_age(df)
    return _per_segment(df, bands.income_segment(), bands.INCOME_SEGMENTS)


def income_levels_by_age(df: DataFrame) -> DataFrame:
    return _per_segment(df, bands.career_segment(), bands.CAREER_SEGMENTS)


def sales_by_date(df: DataFrame, day: DateLike) -> DataFrame:
    """One day's figures; no row when nothing was sold."""
    out = filters.on_day(df, day).agg(
        F.lit(str(day)).alias("date"),
        n_rows().alias("transaction_count"),
        total().alias("daily_revenue"),
        n_distinct("customer_id").alias("unique_customers"),
        n_distinct("receipt_number").alias("unique_receipts"),
        mean("receipt_total_sgd").alias("avg_receipt_value"),
    )
    return out.filter(F.col("transaction_count") > 0)


def customer_totals(df: DataFrame, customer_id: str) -> DataFrame:
    """One customer's totals; no row for an unknown customer."""
    out = filters.eq(df, "customer_id", str(customer_id)).agg(
        F.lit(str(customer_id)).alias("customer_id"),
        n_rows().alias("total_transactions"),
        total().alias("total_spent"),
        n_distinct("receipt_number").alias("total_receipts"),
        low("date").alias("first_purchase"),
        high("date").alias("last_purchase"),
    )
    return out.filter(F.col("total_transactions") > 0)


def customer_recent(df: DataFrame, customer_id: str, k: int = 10) -> DataFrame:
    """One customer's latest purchases."""
    rows = filters.eq(df, "customer_id", str(customer_id))
    return ranking.top_k(rows, k, "date", *ROW_ID).select(
        "product_name", "units_sold", F.col(AMOUNT).alias("amount"), "date"
    )


def receipt_items(df: DataFrame, receipt_number: str | int) -> DataFrame:
    """The items of a receipt by product name. Customer, date and total are those
    of its first item."""
    rows = filters.eq(df, "receipt_number", str(receipt_number))
    first = rows.agg(
        F.min_by(
            F.struct("customer_id", "date", "receipt_total_sgd"),
            F.struct("product_name", "transaction_id", "product_id", AMOUNT),
        )
    ).scalar()
    items = rows.select(
        "receipt_number",
        first.getField("customer_id").alias("customer_id"),
        first.getField("date").alias("date"),
        first.getField("receipt_total_sgd").alias("receipt_total_sgd"),
        "product_id",
        "product_name",
        "units_sold",
        "unit_price_sgd",
        F.col(AMOUNT).alias("total_amount_sgd"),
    )
    return ranking.order_by(items, "product_name", "product_id", "total_amount_sgd")
