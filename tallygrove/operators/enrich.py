"""Columns derived from a sale's date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import calendar as cal
from tallygrove.operators import intervals
from tallygrove.operators.dimensions import BROADCAST_ROWS, calendar_days
from tallygrove.schema import DAY_PARTITION, MONTH_PARTITION


def enrich_calendar(df: DataFrame) -> DataFrame:
    """hour, day_of_week (+ text), month (+ text) and year of the sale."""
    dow, month = cal.day_of_week("date"), F.month("date")
    return df.withColumns(
        {
            "hour": F.hour("date"),
            "day_of_week": dow,
            "day_of_week_text": cal.weekday_text(dow),
            "month": month,
            "month_text": cal.month_text(month),
            "year": F.year("date"),
        }
    )


def enrich_discount(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Tag each sale with its discount period (null outside of all).

    Without a calendar table the standard periods, which lie in November to
    January, are computed from the date.
    With one, the range join "date between start and end" runs as an equality
    join: the periods are exploded to days first. The day table is broadcast
    when it has been counted to be small, and joined by Spark's choice if not.
    """
    if calendar is None:
        tagged = df.withColumn("discount_period", cal.discount_period("date"))
        applied = F.col("discount_period").isNotNull()
        for name in (MONTH_PARTITION, DAY_PARTITION):
            if name in df.columns:  # lets a filter on discounted sales skip partitions
                applied = F.month(name).isin(1, 11, 12) & applied
        return tagged.withColumn("discount_applied", applied)
    days = calendar_days(calendar)
    if days.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        days = F.broadcast(days)
    tagged = (
        df.withColumn("_day", F.to_date("date"))
        .join(days.withColumnRenamed("day", "_day"), "_day", "left")
        .drop("_day")
    )
    return tagged.withColumn("discount_applied", F.col("discount_period").isNotNull())


def enrich_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Tag each sale with the period (discount_period) of lowest ``prio`` that holds its time. Periods run from
    ``start_t`` to before ``end_t``, to any second of a day, and may overlap; see
    :mod:`tallygrove.operators.intervals`."""
    named = periods.select("prio", "discount_period", "start_t", "end_t")
    tagged = intervals.tag_first(df.drop("discount_period", "prio"), named, "prio", closed=False).drop("prio")
    return tagged.withColumn("discount_applied", F.col("discount_period").isNotNull())


def enrich_sales(df: DataFrame) -> DataFrame:
    """The table the reports read: calendar and discount columns, and the
    customer id under its second name. Only expressions: what a report does not
    use is pruned from its plan."""
    return enrich_discount(enrich_calendar(df)).withColumn("customer_number", F.col("customer_id"))


def cyclic_features(df: DataFrame) -> DataFrame:
    """Sine and cosine of the weekday (period 7) and of the month (period 12)."""
    dow_sin, dow_cos = cal.cyclic("day_of_week", 7)
    month_sin, month_cos = cal.cyclic("month", 12)
    return df.withColumns(
        {
            "day_of_week_sin": dow_sin,
            "day_of_week_cos": dow_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
        }
    )
