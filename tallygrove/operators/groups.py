"""Shares, second-level aggregates and matrices over aggregated rows.

The inputs are already grouped, so they hold one row per segment, day or
product; none of these steps reads sales rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.measures import as_col, percent, ratio


def by(df: DataFrame, *keys: Column | str):
    """groupBy on expressions; null keys form their own group."""
    return df.groupBy(*[as_col(k) for k in keys])


def by_labelled(
    df: DataFrame, label: str, key: str, name_of: Callable[[Column], Column], *measures: Column
) -> DataFrame:
    """Group by a label and its sort key, list in key order, drop the key. The
    label follows from the key, so it is added to the few grouped rows instead of
    travelling through the shuffle."""
    per = df.groupBy(key).agg(*measures).withColumn(label, name_of(F.col(key)))
    return per.orderBy(F.asc_nulls_last(key)).drop(key)


def share_of_group(
    agg: DataFrame, group: str, measure: str, share: str, total: str | None = None, digits: int | None = 2
) -> DataFrame:
    """Each row's percentage of its group's total. The total is summed over the
    grouped rows, which saves the second scan and the join."""
    whole = F.sum(measure).over(Window.partitionBy(group))
    if total:
        agg = agg.withColumn(total, whole.cast(agg.schema[measure].dataType))
        whole = F.col(total)
    return agg.withColumn(share, percent(measure, whole, digits))


def share_of_total(agg: DataFrame, measure: str, share: str, digits: int | None = 2) -> DataFrame:
    """Each row's percentage of the overall total, for results of a few rows."""
    whole = F.sum(measure).over(Window.partitionBy())
    return agg.withColumn(share, percent(measure, whole, digits))


def ratio_to_overall(agg: DataFrame, own: Column, amount: str, count: str, name: str) -> DataFrame:
    """A value of each row against the average over all rows, for results of a
    few rows that together cover the whole table: the overall average comes from
    their amounts and counts, not from a second scan."""
    everything = Window.partitionBy()
    overall = ratio(F.sum(amount).over(everything), F.sum(count).over(everything))
    return agg.withColumn(name, F.try_divide(own, overall))


def rollup_again(agg: DataFrame, key: Column | str, *measures: Column) -> DataFrame:
    """Aggregate of an aggregate."""
    return agg.groupBy(as_col(key)).agg(*measures)


def matrix(agg: DataFrame, row: str, col: str, values: Sequence, measure: str) -> DataFrame:
    """Pivot with a fixed list of columns; empty cells are 0. Listing the
    columns spares the extra job that would look for them."""
    return agg.groupBy(row).pivot(col, list(values)).agg(F.sum(measure)).na.fill(0, list(map(str, values)))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def overall(df: DataFrame, *measures: Column) -> DataFrame:
    """Aggregate of the whole table: always one row, also for an empty one."""
    return df.agg(*measures)
