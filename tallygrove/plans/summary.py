"""The summary report: best days and months, countries, age groups, hours,
products and years, with the rows that stand out.

"All types" means refunds and exchanges count as well; the other reports look at
sales only. Highlights name the row that really holds the extreme of a measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import bands, calendar
from tallygrove.functions.measures import (
    high, low, mean, mean_if, n_distinct, n_if, n_rows, percent, ratio, total, total_if,
)
from tallygrove.operators import filters, groups, ranking
from tallygrove.plans.exports import hourly_sales
from tallygrove.schema import AMOUNT, ROW_ID, SALE

_KNOWN_BANDS = bands.AGE_BANDS_3[:3]


def _year() -> Column:
    return F.col("year").cast("bigint").alias("year")


def sale_stats(df: DataFrame) -> DataFrame:
    return filters.sales_only(df).agg(
        n_rows().alias("total_rows"),
        low("date").alias("start_date"),
        high("date").alias("end_date"),
        mean().alias("avg_sales"),
        low(AMOUNT).alias("min_sales"),
        high(AMOUNT).alias("max_sales"),
    )


def best_weekday(df: DataFrame) -> DataFrame:
    per = filters.sales_only(df).groupBy("day_of_week_text", "day_of_week").agg(
        total().alias("total_sales")
    )
    return ranking.top_k(per, 1, "total_sales", "day_of_week").select("day_of_week_text", "total_sales")


def best_month(df: DataFrame) -> DataFrame:
    per = filters.sales_only(df).groupBy("month_text", "month").agg(total().alias("total_sales"))
    return ranking.top_k(per, 1, "total_sales", "month").select("month_text", "total_sales")


def _days(df: DataFrame, *measures: Column) -> DataFrame:
    """One row per day; the labels are added to the grouped rows."""
    per = df.groupBy(F.to_date("date").alias("sales_date")).agg(
        n_rows().alias("total_transactions"), total().alias("daily_revenue"), *measures
    )
    return per.withColumns(
        {
            "day_of_week_text": calendar.weekday_text(calendar.day_of_week("sales_date")),
            "month_text": calendar.month_text(F.month("sales_date")),
            "year": F.year("sales_date").cast("bigint"),
        }
    )


@ranking.listed("-daily_revenue", "sales_date")
def daily_sales(df: DataFrame) -> DataFrame:
    """All types, per day."""
    return _days(
        df,
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
        n_distinct("receipt_number").alias("unique_receipts"),
    )


_DAY_COLUMNS = [
    "sales_date", "day_of_week_text", "month_text", "year", "daily_revenue", "total_transactions",
]


def top_days(df: DataFrame, k: int = 10) -> DataFrame:
    return ranking.top_k(_days(df), k, "daily_revenue", "sales_date").select(_DAY_COLUMNS)


def bottom_days(df: DataFrame, k: int = 10) -> DataFrame:
    return ranking.bottom_k(_days(df), k, "daily_revenue", "sales_date").select(_DAY_COLUMNS)


def daily_highlights(df: DataFrame) -> DataFrame:
    return ranking.highlights(
        daily_sales.rows(df),
        ["sales_date", "day_of_week_text"],
        {
            "best_revenue": ("daily_revenue", "max"),
            "lowest_revenue": ("daily_revenue", "min"),
            "most_transactions": ("total_transactions", "max"),
            "fewest_transactions": ("total_transactions", "min"),
            "most_customers": ("unique_customers", "max"),
            "best_avg_value": ("avg_transaction_value", "max"),
        },
    )


def daily_stats(df: DataFrame) -> DataFrame:
    return daily_sales.rows(df).agg(
        n_rows().alias("days"),
        mean("daily_revenue").alias("avg_daily_revenue"),
        low("daily_revenue").alias("min_daily_revenue"),
        high("daily_revenue").alias("max_daily_revenue"),
        mean("total_transactions").alias("avg_daily_transactions"),
        mean("unique_customers").alias("avg_daily_customers"),
    )


@ranking.listed("-total_revenue", "country")
def country_sales(df: DataFrame) -> DataFrame:
    """All types, per country."""
    return df.groupBy("country").agg(
        n_rows().alias("total_transactions"),
        total().alias("total_revenue"),
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
    )


_FOUR_MEASURES = {
    "transactions": "total_transactions",
    "revenue": "total_revenue",
    "avg_value": "avg_transaction_value",
    "customers": "unique_customers",
}


def _both_ends(measures: dict[str, str]) -> dict[str, tuple[str, str]]:
    return {
        f"{side}_{name}": (column, side) for name, column in measures.items() for side in ("max", "min")
    }


def country_highlights(df: DataFrame) -> DataFrame:
    return ranking.highlights(country_sales.rows(df), ["country"], _both_ends(_FOUR_MEASURES))


def _age_country(df: DataFrame) -> DataFrame:
    return filters.known(df, "age").groupBy("country", bands.age_band3().alias("age_group")).agg(
        n_rows().alias("total_transactions"),
        total().alias("total_revenue"),
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
        mean("age").alias("avg_age_in_group"),
    )


def age_country(df: DataFrame) -> DataFrame:
    """All types with a known age, per country and age band."""
    return ranking.order_by_segment(_age_country(df), "age_group", bands.AGE_BANDS_3, "country")


def age_country_highlights(df: DataFrame) -> DataFrame:
    measures = {k: v for k, v in _FOUR_MEASURES.items() if k != "transactions"}
    return ranking.highlights(_age_country(df), ["country", "age_group"], _both_ends(measures))


@ranking.listed("-overall_avg_age", "country")
def age_distribution(df: DataFrame) -> DataFrame:
    """Per country: sales by age band and average ages, one decimal."""
    young, middle, senior = (F.col("age") < 25, F.col("age").between(25, 40), F.col("age") >= 41)
    return filters.known(df, "age").groupBy("country").agg(
        n_if(young).alias("under_25_customers"),
        n_if(middle).alias("age_25_40_customers"),
        n_if(senior).alias("age_41_plus_customers"),
        F.round(mean_if(young, "age"), 1).alias("avg_age_under_25"),
        F.round(mean_if(middle, "age"), 1).alias("avg_age_25_40"),
        F.round(mean_if(senior, "age"), 1).alias("avg_age_41_plus"),
        F.round(mean("age"), 1).alias("overall_avg_age"),
    )


def age_distribution_highlights(df: DataFrame) -> DataFrame:
    wanted = {
        "oldest_market": ("overall_avg_age", "max"),
        "youngest_market": ("overall_avg_age", "min"),
        "most_young": ("under_25_customers", "max"),
        "most_senior": ("age_41_plus_customers", "max"),
    }
    for band in ("under_25", "25_40", "41_plus"):
        wanted[f"highest_{band}"] = (f"avg_age_{band}", "max")
        wanted[f"lowest_{band}"] = (f"avg_age_{band}", "min")
    return ranking.highlights(age_distribution.rows(df), ["country"], wanted)


def _age_revenue_share(df: DataFrame) -> DataFrame:
    per = filters.known(df, "age").groupBy("country", bands.age_band3().alias("age_group")).agg(
        total().alias("age_group_revenue")
    )
    return groups.share_of_group(
        per, "country", "age_group_revenue", "revenue_percentage", "country_total_revenue"
    )


def age_revenue_share(df: DataFrame) -> DataFrame:
    """Each age band's share of its country's revenue."""
    return ranking.order_by_segment(
        _age_revenue_share(df), "age_group", bands.AGE_BANDS_3, "country"
    )


def age_share_highlights(df: DataFrame) -> DataFrame:
    """Countries with the highest and lowest share of each band, and overall."""
    share, band = F.col("revenue_percentage"), F.col("age_group")
    wanted = {"max_overall": (share, "max"), "min_overall": (share, "min")}
    for name in _KNOWN_BANDS:
        for side in ("max", "min"):
            wanted[f"{side}_{name}"] = (F.when(band == name, share), side)
    return ranking.highlights(_age_revenue_share(df), ["country", "age_group"], wanted)


def hour_highlights(df: DataFrame) -> DataFrame:
    return ranking.highlights(hourly_sales.rows(df), ["hour"], _both_ends(_FOUR_MEASURES))


@ranking.listed("-total_revenue", "time_period")
def time_periods(df: DataFrame) -> DataFrame:
    """Hours rolled up to four periods. The value is the mean of the hourly
    averages, the customers are the sum of the hourly distinct counts."""
    return groups.rollup_again(
        hourly_sales.rows(df),
        bands.time_period("hour").alias("time_period"),
        F.sum("total_transactions").alias("total_transactions"),
        total("total_revenue").alias("total_revenue"),
        F.round(F.avg("avg_transaction_value"), 2).alias("mean_hourly_avg_value"),
        F.sum("unique_customers").alias("sum_hourly_customers"),
    )


def period_highlights(df: DataFrame) -> DataFrame:
    return ranking.best_and_worst(time_periods.rows(df), "total_revenue", "time_period")


_HOUR_COLUMNS = ["hour", "total_revenue", "total_transactions"]


def _plain_hours(df: DataFrame) -> DataFrame:
    return filters.sales_only(df).groupBy(F.col("hour").cast("bigint").alias("hour")).agg(
        total().alias("total_revenue"), n_rows().alias("total_transactions")
    )


def peak_hours(df: DataFrame, k: int = 3) -> DataFrame:
    return ranking.top_k(_plain_hours(df), k, "total_revenue", "hour")


def low_hours(df: DataFrame, k: int = 3) -> DataFrame:
    return ranking.bottom_k(_plain_hours(df), k, "total_revenue", "hour")


def concentration(agg: DataFrame, measure: str) -> DataFrame:
    """Largest and smallest row as a percentage of the total, and their ratio."""
    out = agg.agg(F.max(measure).alias("hi"), F.min(measure).alias("lo"), F.sum(measure).alias("t"))
    peak, lowest = percent("hi", "t", None), percent("lo", "t", None)
    return out.select(
        peak.alias("peak_pct"), lowest.alias("low_pct"), F.try_divide(peak, lowest).alias("peak_to_low")
    )


def revenue_concentration(df: DataFrame) -> DataFrame:
    return concentration(_plain_hours(df), "total_revenue")


def largest_sales(df: DataFrame, at_least=20, k: int = 10) -> DataFrame:
    rows = filters.at_least(df, AMOUNT, at_least)
    return ranking.top_k(rows, k, AMOUNT, *ROW_ID).select(
        "date",
        AMOUNT,
        "country",
        F.col("day_of_week_text").alias("day"),
        F.col("month_text").alias("month"),
        _year(),
    )


def sales_only_by_country(df: DataFrame) -> DataFrame:
    per = filters.sales_only(df).groupBy("country").agg(
        total().alias("total_sales"),
        n_rows().alias("transaction_count"),
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
    )
    return ranking.order_by(per, "-total_sales", "country")


def transaction_breakdown(df: DataFrame) -> DataFrame:
    per = df.groupBy("transaction_desc").agg(
        n_rows().alias("transaction_count"), total().alias("total_amount"), mean().alias("avg_amount")
    )
    out = groups.share_of_total(per, "transaction_count", "percentage")
    return ranking.order_by(out, "-transaction_count", "transaction_desc")


def refund_impact(df: DataFrame) -> DataFrame:
    """What refunds and exchanges add to sales, from one pass."""
    is_sale = F.col("transaction_desc") == SALE
    out = df.agg(
        total().alias("total_revenue"),
        n_rows().alias("total_transactions"),
        total_if(is_sale).alias("sales_revenue"),
        n_if(is_sale).alias("sales_transactions"),
    )
    out = out.withColumns(
        {
            "revenue_impact": (F.col("total_revenue") - F.col("sales_revenue")).cast("decimal(38,2)"),
            "transaction_impact": F.col("total_transactions") - F.col("sales_transactions"),
        }
    )
    return out.withColumns(
        {
            "revenue_impact_pct": percent("revenue_impact", "total_revenue", None),
            "transaction_impact_pct": percent("transaction_impact", "total_transactions", None),
        }
    )


def age_groups_sale(df: DataFrame) -> DataFrame:
    rows = filters.known(filters.sales_only(df), "age")
    per = rows.groupBy(bands.age_band3().alias("age_group")).agg(n_rows().alias("customer_count"))
    return ranking.order_by(per, "-customer_count", "age_group")


def customers_by_country(df: DataFrame) -> DataFrame:
    per = filters.sales_only(df).groupBy("country").agg(
        n_distinct("customer_number").alias("unique_customers")
    )
    return ranking.order_by(per, "-unique_customers", "country")


def _yearly(df: DataFrame, key: str, *measures) -> DataFrame:
    return filters.sales_only(df).groupBy(_year(), key).agg(total().alias("total_sales"), *measures)


def yearly_product_sales(df: DataFrame) -> DataFrame:
    per = _yearly(df, "product_name", n_rows().alias("transaction_count"))
    return ranking.order_by(per, "year", "-total_sales", "product_name")


def _top_sold(df: DataFrame, key: str, k: int) -> DataFrame:
    per = filters.sales_only(df).groupBy(key).agg(total().alias("total_sales"))
    return ranking.top_k(per, k, "total_sales", key)


def _years_of_top(yearly: DataFrame, key: str, k: int) -> DataFrame:
    """Yearly rows of the k keys with the largest total."""
    out = ranking.members_of_top(yearly, key, k, "total_sales")
    return ranking.order_by(out, "year", "-total_sales", key)


def top5_products(df: DataFrame, k: int = 5) -> DataFrame:
    return _top_sold(df, "product_name", k)


def top5_product_years(df: DataFrame, k: int = 5) -> DataFrame:
    return _years_of_top(_yearly(df, "product_name", n_rows().alias("transaction_count")), "product_name", k)


def recent_top_products(df: DataFrame, min_year: int = 2020, k: int = 8) -> DataFrame:
    return _top_sold(filters.from_year(df, min_year), "product_name", k)


def yearly_country_sales(df: DataFrame) -> DataFrame:
    return ranking.order_by(_yearly(df, "country"), "year", "-total_sales", "country")


def top5_countries(df: DataFrame, k: int = 5) -> DataFrame:
    return _top_sold(df, "country", k)


def top5_country_years(df: DataFrame, k: int = 5) -> DataFrame:
    return _years_of_top(_yearly(df, "country"), "country", k)


def _product_country(df: DataFrame, min_year: int) -> DataFrame:
    rows = filters.from_year(filters.sales_only(df), min_year)
    return rows.groupBy("country", "product_name").agg(total().alias("total_sales"))


def product_country_recent(df: DataFrame, min_year: int = 2020) -> DataFrame:
    return ranking.order_by(
        _product_country(df, min_year), "-total_sales", "country", "product_name"
    )


def product_country_matrix(
    df: DataFrame, min_year: int = 2020, products: int = 8, countries: int = 6
) -> DataFrame:
    """Top products by top countries as rows (product, country, total); cells
    without sales are 0."""
    named = filters.known(filters.known(df, "country"), "product_name")
    cells = _product_country(named, min_year)
    rows, cols = ("product_name", products), ("country", countries)
    trimmed = ranking.trim_axes(cells, rows, cols, "total_sales")
    # both axes have a fixed length, so the grid is spelled out from a list
    country_list = ranking.top_keys(cells, *cols, "total_sales").agg(F.collect_list("country")).scalar()
    grid = ranking.top_keys(cells, *rows, "total_sales").select(
        "product_name", F.explode(country_list).alias("country")
    )
    out = grid.join(trimmed, ["product_name", "country"], "left")
    return out.na.fill(0, ["total_sales"])


def product_country_pivot(
    df: DataFrame, min_year: int = 2020, products: int = 8, countries: int = 6
) -> DataFrame:
    """The same matrix with one column per country. The column names are data,
    so the country names (a fixed number) are read first."""
    long = product_country_matrix(df, min_year, products, countries)
    names = sorted(r[0] for r in long.select("country").distinct().collect())
    return groups.matrix(long, "product_name", "country", names, "total_sales")


def month_of_year_sales(df: DataFrame) -> DataFrame:
    per = filters.sales_only(df).groupBy("month_text", F.col("month").cast("bigint").alias("month")).agg(
        total().alias("total_sales"), n_rows().alias("transaction_count")
    )
    return ranking.order_by(per, "month")


def weekday_sales(df: DataFrame) -> DataFrame:
    number = F.col("day_of_week").cast("bigint").alias("day_of_week")
    per = filters.sales_only(df).groupBy("day_of_week_text", number).agg(
        total().alias("total_sales"), n_rows().alias("transaction_count")
    )
    return ranking.order_by(per, "day_of_week")


def age_country_matrix(df: DataFrame) -> DataFrame:
    """Revenue per country with a column per age band."""
    rows = filters.known(filters.sales_only(df), "age")
    per = rows.groupBy("country", bands.age_band3().alias("age_group")).agg(total().alias("revenue"))
    wide = groups.matrix(per, "country", "age_group", _KNOWN_BANDS, "revenue")
    names = dict(zip(_KNOWN_BANDS, ["under_25", "age_25_40", "age_41_plus"]))
    return ranking.order_by(
        wide.select("country", *[F.col(f"`{b}`").cast("decimal(38,2)").alias(n) for b, n in names.items()]),
        "country",
    )


def top10_products(df: DataFrame, k: int = 10) -> DataFrame:
    per = filters.sales_only(df).groupBy("product_name").agg(
        total().alias("total_revenue"),
        n_rows().alias("transaction_count"),
        mean().alias("avg_transaction_value"),
        n_distinct("customer_number").alias("unique_customers"),
    )
    return ranking.top_k(per, k, "total_revenue", "product_name")


def yearly_customers(df: DataFrame) -> DataFrame:
    """Distinct customers per year (not only first-time ones) and revenue."""
    per = filters.sales_only(df).groupBy(_year()).agg(
        n_distinct("customer_number").alias("unique_customers"), total().alias("total_revenue")
    )
    return ranking.order_by(per, "year")
