"""Row filters.

Conditions are written as plain comparisons of a column with a literal, the form
Spark pushes down to Parquet. Date conditions also bound the partition column of
a stored table, so whole partitions are skipped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.bands import age_band3n
from tallygrove.functions.measures import n_if
from tallygrove.schema import DAY_PARTITION, MONTH_PARTITION, SALE

DateLike = str | dt.date | dt.datetime


def _moment(value: DateLike) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


def _ntz(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _partition_range(df: DataFrame, lo: dt.datetime | None, hi: dt.datetime | None) -> DataFrame:
    for name, day in ((DAY_PARTITION, False), (MONTH_PARTITION, True)):
        if name not in df.columns:
            continue
        for bound, is_low in ((lo, True), (hi, False)):
            if bound is not None:
                edge = F.lit(bound.date().replace(day=1) if day else bound.date())
                df = df.filter(F.col(name) >= edge if is_low else F.col(name) <= edge)
    return df


def date_range(
    df: DataFrame,
    start: DateLike | None = None,
    end: DateLike | None = None,
    end_inclusive: bool = False,
) -> DataFrame:
    """Sales from ``start`` to ``end``. A bound without a time means midnight,
    so by default the day ``end`` itself is left out but for that moment;
    ``end_inclusive`` takes the whole day."""
    lo = _moment(start) if start is not None else None
    hi = _moment(end) if end is not None else None
    df = _partition_range(df, lo, hi)
    if lo is not None:
        df = df.filter(F.col("date") >= _ntz(lo))
    if hi is not None:
        if end_inclusive:
            df = df.filter(F.col("date") < _ntz(hi + dt.timedelta(days=1)))
        else:
            df = df.filter(F.col("date") <= _ntz(hi))
    return df


def on_day(df: DataFrame, day: DateLike) -> DataFrame:
    start = _moment(day)
    return date_range(df, start, start, end_inclusive=True)


def from_year(df: DataFrame, year: int) -> DataFrame:
    """Sales of the year and later, as a range on the date: unlike a condition
    on ``year(date)`` it prunes partitions and row groups."""
    return date_range(df, dt.datetime(year, 1, 1))


def filter_sales(
    df: DataFrame,
    start: DateLike | None = None,
    end: DateLike | None = None,
    product_id: str | None = None,
    customer_id: str | None = None,
    min_age: int | None = None,
    max_age: int | None = None,
) -> DataFrame:
    """All given conditions together; those left out do not filter."""
    df = date_range(df, start, end)
    if product_id is not None:
        df = eq(df, "product_id", product_id)
    if customer_id is not None:
        df = eq(df, "customer_id", customer_id)
    if min_age is not None:
        df = at_least(df, "age", min_age)
    if max_age is not None:
        df = df.filter(F.col("age") <= max_age)
    return df


def eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def sales_only(df: DataFrame) -> DataFrame:
    """Sales without refunds and exchanges."""
    return eq(df, "transaction_desc", SALE)


def between(df: DataFrame, column: str, lo, hi) -> DataFrame:
    return df.filter(F.col(column).between(lo, hi))


def known(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def one_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def discounted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("discount_applied"))


def at_least(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) >= value)


def above(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) > value)


def at_hour(df: DataFrame, hour: int) -> DataFrame:
    return df.filter(F.hour("date") == hour)


def in_band(df: DataFrame, band: str) -> DataFrame:
    return df.filter(age_band3n("age") == band)


def probe_counts(df: DataFrame) -> DataFrame:
    """Ten filtered counts, one per commonly filtered column.

    The values to look for come from the data: the first day, and the smallest
    non-null value of each text column. They are found in one aggregate that the
    counting pass uses as a scalar subquery: two scans for all ten counts.
    """
    texts = ["customer_id", "product_id", "country", "city", "transaction_desc"]
    probes = df.agg(
        F.min(F.to_date("date")).alias("day"), *[F.min(c).alias(c) for c in texts]
    )

    found = probes.select(F.struct(*probes.columns)).scalar()

    def value(c: str) -> Column:
        return found.getField(c)

    return df.agg(
        n_if(F.to_date("date") == value("day")).alias("first_day"),
        n_if(F.col("customer_id") == value("customer_id")).alias("customer"),
        n_if(F.col("product_id") == value("product_id")).alias("product"),
        n_if(F.col("age").between(25, 40)).alias("age_25_40"),
        n_if(F.col("income") > 50000).alias("income_above_50k"),
        n_if(F.col("country") == value("country")).alias("country"),
        n_if(F.col("city") == value("city")).alias("city"),
        n_if(F.col("gender") == "F").alias("female"),
        n_if(F.col("transaction_desc") == value("transaction_desc")).alias("transaction_type"),
        n_if(F.hour("date") == 12).alias("hour_12"),
    )
