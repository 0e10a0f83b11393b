"""Days, weekdays and calendar months of sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import calendar
from tallygrove.functions.measures import mean, n_distinct, n_rows, percent, ratio, total
from tallygrove.operators import filters, groups, ranking
from tallygrove.plans.summary import concentration

_WEEKDAYS, _WEEKEND = calendar.WEEKDAY_NAMES[:5], calendar.WEEKDAY_NAMES[5:]


def _days(df: DataFrame, *measures: Column) -> DataFrame:
    return (
        filters.sales_only(df)
        .groupBy(F.to_date("date").alias("sale_date"))
        .agg(n_rows().alias("transactions"), total().alias("revenue"), *measures)
        .withColumns(
            {
                "day_name": calendar.weekday_name(calendar.day_of_week("sale_date")),
                "day_number": calendar.day_number("sale_date"),
            }
        )
    )


def daily_breakdown(df: DataFrame) -> DataFrame:
    per = _days(
        df,
        mean().alias("avg_value"),
        n_distinct("customer_id").alias("customers"),
        n_distinct("receipt_number").alias("receipts"),
    )
    return ranking.order_by(per, "sale_date")


def daily_extremes(df: DataFrame) -> DataFrame:
    """Best and worst day by revenue, number of sales and average value."""
    wanted = {
        f"{side}_{name}": (column, "max" if side == "best" else "min")
        for name, column in (
            ("revenue", "revenue"), ("transactions", "transactions"), ("avg_value", "avg_value"),
        )
        for side in ("best", "worst")
    }
    return ranking.highlights(_days(df, mean().alias("avg_value")), ["sale_date", "day_name"], wanted)


def weekday_profile(df: DataFrame) -> DataFrame:
    """Averages per day for each weekday, and value per transaction. A customer
    counts once per day."""
    per = groups.rollup_again(
        _days(df, n_distinct("customer_id").alias("customers")),
        "day_name",
        n_rows().alias("days"),
        mean("transactions").alias("avg_transactions"),
        mean("revenue").alias("avg_revenue"),
        mean("customers").alias("avg_customers"),
        ratio(F.sum("revenue"), F.sum("transactions")).alias("avg_value"),
    )
    return ranking.order_by(per, "-avg_revenue", "day_name")


def _by_weekday(df: DataFrame) -> DataFrame:
    return groups.rollup_again(
        _days(df),
        "day_name",
        mean("transactions").alias("avg_transactions"),
        mean("revenue").alias("avg_revenue"),
    )


def _part_of_week(names: list[str], measure: str) -> Column:
    """Mean over the weekdays; a weekday without sales counts as zero. Added in
    the order of the week, so the result is the same on every run."""
    out = None
    for name in names:
        value = F.coalesce(F.max(F.when(F.col("day_name") == name, F.col(measure))), F.lit(0.0))
        out = value if out is None else out + value
    return out / F.lit(float(len(names)))


def weekday_vs_weekend(df: DataFrame) -> DataFrame:
    """Weekday against weekend averages; changes in percent of the weekday."""
    out = _by_weekday(df).agg(
        _part_of_week(_WEEKDAYS, "avg_revenue").alias("weekday_revenue"),
        _part_of_week(_WEEKEND, "avg_revenue").alias("weekend_revenue"),
        _part_of_week(_WEEKDAYS, "avg_transactions").alias("weekday_transactions"),
        _part_of_week(_WEEKEND, "avg_transactions").alias("weekend_transactions"),
    )

    def change(measure: str) -> Column:
        quotient = F.try_divide(F.col(f"weekend_{measure}"), F.col(f"weekday_{measure}"))
        return ((quotient - 1.0) * 100.0).alias(f"{measure}_change_pct")

    return out.select("*", change("revenue"), change("transactions"))


def day_concentration(df: DataFrame) -> DataFrame:
    return concentration(_days(df), "revenue")


_DAY = ["sale_date", "day_name", "revenue", "transactions"]


def top5_days(df: DataFrame, k: int = 5) -> DataFrame:
    return ranking.top_k(_days(df), k, "revenue", "sale_date").select(_DAY)


def bottom5_days(df: DataFrame, k: int = 5) -> DataFrame:
    return ranking.bottom_k(_days(df), k, "revenue", "sale_date").select(_DAY)


def calendar_month_sales(df: DataFrame) -> DataFrame:
    per = (
        filters.sales_only(df)
        .groupBy(F.year("date").cast("bigint").alias("year"), F.month("date").cast("bigint").alias("month"))
        .agg(
            n_rows().alias("transactions"),
            total().alias("revenue"),
            mean().alias("avg_value"),
            n_distinct("customer_id").alias("customers"),
        )
        .withColumn("month_name", calendar.month_name(F.col("month").cast("int")))
    )
    return ranking.order_by(per, "year", "month")


def weekday_recommendation(df: DataFrame) -> DataFrame:
    """Best and worst weekday by average revenue; is the weekend stronger?"""
    rev, name = F.col("avg_revenue"), F.col("day_name")
    out = _by_weekday(df).agg(
        F.min_by(name, F.struct(-rev, name)).alias("best_weekday"),
        F.min_by(name, F.struct(rev, name)).alias("worst_weekday"),
        (_part_of_week(_WEEKEND, "avg_revenue") > _part_of_week(_WEEKDAYS, "avg_revenue")).alias(
            "weekend_stronger"
        ),
    )
    return out.filter(F.col("best_weekday").isNotNull())
