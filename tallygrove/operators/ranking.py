"""Orderings, top-k and windows. Nulls sort last in both directions."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.bands import segment_order
from tallygrove.functions.measures import as_col, n_rows
from tallygrove.schema import MONTH_PARTITION, ROW_ID, SALES_COLUMNS
from tallygrove.session import shared_dir


def _order(keys: Sequence[str]) -> list[Column]:
    """``"-name"`` is descending, ``"name"`` ascending."""
    return [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys]


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*_order(keys))


def listed(*keys: str):
    """Decorator for reports: list the rows in this order. Reports that build on
    the rows take them unsorted, as ``report.rows(df)``."""

    def wrap(rows: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(rows)
        def report(df: DataFrame, **params) -> DataFrame:
            return order_by(rows(df, **params), *keys)

        report.rows = rows
        return report

    return wrap


def order_by_segment(df: DataFrame, label: str, labels: Sequence[str], *first: str) -> DataFrame:
    """Order by the given keys, then by the label's place in its list."""
    return df.orderBy(*_order(first), segment_order(label, list(labels)))


def top_k(df: DataFrame, k: int, measure: str, *tiebreak: str) -> DataFrame:
    """The k largest; each task keeps k rows, only those meet."""
    return df.orderBy(*_order([f"-{measure}", *tiebreak])).limit(k)


def bottom_k(df: DataFrame, k: int, measure: str, *tiebreak: str) -> DataFrame:
    return df.orderBy(*_order([measure, *tiebreak])).limit(k)


def months_of_first(df: DataFrame, n: int, newest: bool) -> DataFrame:
    """Only the months that can hold the first n rows by date.

    Rows are counted per month first, which reads the columns that ``df``
    filters by and no others; then only those months are read in full. Without
    the partition column, or with fewer rows than asked for, all rows stay.
    """
    if MONTH_PARTITION not in df.columns:
        return df
    month = F.col(MONTH_PARTITION)
    seen = 0
    counts = {r[0]: r[1] for r in df.groupBy(month).count().collect() if r[0] is not None}
    for edge in sorted(counts, reverse=newest):
        seen += counts[edge]
        if seen >= n:
            return df.filter(month >= F.lit(edge) if newest else month <= F.lit(edge))
    return df


def earliest(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by date, in a fixed order."""
    rows = months_of_first(df, n, newest=False)
    return rows.orderBy(*_order(["date", *ROW_ID])).limit(n)


def sample(df: DataFrame, n: int) -> DataFrame:
    """First n sales in a fixed order."""
    return earliest(df, n).select(SALES_COLUMNS)


def page(df: DataFrame, number: int, size: int, days: DataFrame | None = None) -> DataFrame:
    """One page of the rows, newest first. Pages count from 1. With ``days``, the number of rows
    (n) per day as stored beside a table, no rows are counted to find the page."""
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("page starts at 1 and page_size lies between 1 and 1000")
    df, skip = _around(df, (number - 1) * size, size, days)
    return df.orderBy(*_order(["-date", *_tiebreak(df)])).offset(skip).limit(size)


def _tiebreak(df: DataFrame) -> list[str]:
    """A full order of the rows of a date, up to full copies."""
    return [*ROW_ID, *[c for c in SALES_COLUMNS if c in df.columns and c not in ("date", *ROW_ID)]]


def _around(df: DataFrame, skip: int, n: int, days: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Of the rows, newest first, those of the months and days that rows skip+1 to
    skip+n can lie in, and how many of them are still to be skipped.

    Stored counts per day tell the days at once. Without them rows are counted per month, then per
    day of the months that are left; without the partition column all rows stay. Either way a deep page
    sorts a few days and not all rows before it.
    """
    if days is not None:
        keep, skip = _holding([(r["day"], r["n"]) for r in days.select("day", "n").collect()], skip, n)
        if not keep:
            return df.limit(0), 0
        months = sorted({d and d.replace(day=1) for d in keep}, key=lambda d: (d is not None, d or dt.date.min))
        if MONTH_PARTITION in df.columns:
            df = df.filter(_among(F.col(MONTH_PARTITION), months))
        return df.filter(_among(F.to_date("date"), keep)), skip
    if MONTH_PARTITION not in df.columns:
        return df, skip
    for part in (F.col(MONTH_PARTITION), F.to_date("date")):
        counts = df.groupBy(part.alias("d")).agg(F.count("*").alias("n")).collect()
        keep, skip = _holding([(r["d"], r["n"]) for r in counts], skip, n)
        if not keep:
            return df.limit(0), 0
        df = df.filter(_among(part, keep))
    return df, skip


def _holding(counts: Sequence[tuple[dt.date | None, int]], skip: int, n: int) -> tuple[list, int]:
    """The dates that rows skip+1 to skip+n lie in, newest first and no date last, and how many rows
    of them come before."""
    before, keep, first = 0, [], 0
    for d, rows in sorted(counts, key=lambda c: (c[0] is not None, c[0] or dt.date.min), reverse=True):
        if before < skip + n and before + rows > skip:
            first = first if keep else before
            keep.append(d)
        before += rows
    return keep, skip - first


def _among(part: Column, dates: Sequence[dt.date | None]) -> Column:
    """The date is one of a run of dates."""
    dated = [d for d in dates if d is not None]
    inside = part.between(F.lit(min(dated)), F.lit(max(dated))) if dated else F.lit(False)
    return inside | part.isNull() if None in dates else inside


def _behind(key: str, value: Column | None, descending: bool = False) -> Column:
    """The row sorts behind the value of this key, nulls being last."""
    c = F.col(key)
    if value is None:
        return F.lit(False)
    return (c < value if descending else c > value) | c.isNull()


def copies_shown(rows: Sequence[Mapping[str, object]], last: Mapping[str, object], before: int = 0) -> int:
    """How many copies of the row ``last`` have been shown after this page. ``before`` is what
    this function gave for the page before it, if that ended with the same row."""
    n = sum(r == last for r in rows)
    return n + (before if n == len(rows) else 0)


def page_after(df: DataFrame, last: Mapping[str, object] | None, size: int, shown: int = 1) -> DataFrame:
    """The page that follows the row ``last``, of which ``shown`` full copies were listed so far.

    Unlike an offset, the cost does not grow with the page's number: what came
    before is filtered out in the scan, and a task keeps ``size`` rows beside those copies.
    """
    keys = ["date", *_tiebreak(df)]
    if last is not None:
        keys = [k for k in keys if k in last]
        value = {
            k: None if last[k] is None else F.lit(str(last[k])).cast(df.schema[k].dataType) for k in keys
        }
        behind, same = F.lit(False), F.lit(True)
        for k in keys:
            behind = behind | (same & _behind(k, value[k], k == "date"))
            same = same & (F.col(k).isNull() if value[k] is None else F.col(k).eqNullSafe(value[k]))
        if last["date"] is not None:
            # implied by the rest, in the form that prunes partitions and row groups
            df = df.filter((F.col("date") <= value["date"]) | F.col("date").isNull())
            if MONTH_PARTITION in df.columns:
                month = F.lit(last["date"].date().replace(day=1))
                df = df.filter((F.col(MONTH_PARTITION) <= month) | F.col(MONTH_PARTITION).isNull())
        df = df.filter(behind | same)
    skip = shown if last is not None else 0
    df = months_of_first(df, size + skip, newest=True)
    return df.orderBy(*_order(["-date", *keys[1:]])).offset(skip).limit(size)


def with_previous(agg: DataFrame, order: str, cols: Mapping[str, str]) -> DataFrame:
    """Values of the preceding row, for aggregated rows such as months."""
    w = Window.orderBy(F.asc_nulls_last(order))
    return agg.withColumns({new: F.lag(old).over(w) for old, new in cols.items()})


def _rank_few(agg: DataFrame, measure: str, name: str) -> DataFrame:
    """Rank in one task, for a bounded number of rows."""
    rank = F.rank().over(Window.orderBy(F.desc_nulls_last(measure)))
    return agg.withColumn(name, rank.cast("bigint"))


def _placed(values: DataFrame, order: list[Column]) -> DataFrame:
    """(values, n) with ``_before``: the sum of n over the rows that come before.

    The rows are dealt by ranges and written, so that both steps see the same ranges: sums
    per range, of which there are few, and a running sum inside each range.
    """
    spark = values.sparkSession
    path = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex[:12]}"
    values.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    above = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("_range").agg(F.sum("_n").alias("_s"))
    sums = sums.select("_range", F.coalesce(F.sum("_s").over(above.orderBy("_range")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_n").over(above.partitionBy("_range").orderBy(*order)), F.lit(0))
    rows = ranges.withColumn("_inside", inside).join(F.broadcast(sums), "_range")
    return rows.withColumn("_before", F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside", "_n")


def with_rank(agg: DataFrame, measure: str, name: str = "rank") -> DataFrame:
    """Rank by a measure, largest first; ties share a rank and leave a gap, nulls come
    last. No task sees more than a range of the distinct values."""
    value = F.col(measure)
    counts = agg.groupBy(value.alias("_value")).agg(n_rows().alias("_n"))
    ranks = _placed(counts, [F.desc_nulls_last("_value")])
    joined = agg.join(ranks, value.eqNullSafe(F.col("_value")))
    return joined.withColumn(name, (F.col("_before") + 1).cast("bigint")).drop("_value", "_before")


def top_ranked(agg: DataFrame, k: int, measure: str, key: str, name: str = "rank") -> DataFrame:
    """The first k rows by rank. They are picked first and ranked then: who
    comes behind does not change a rank, so no task sees more than k rows."""
    return _rank_few(top_k(agg, k, measure, key), measure, name)


def with_position(agg: DataFrame, measure: str, tiebreak: str, name: str = "position") -> DataFrame:
    """Places 1, 2, ... in one task: for the rows of a short report, such as one per country."""
    w = Window.orderBy(F.desc_nulls_last(measure), F.asc_nulls_last(tiebreak))
    return agg.withColumn(name, F.row_number().over(w).cast("bigint"))


def top_k_per_group(agg: DataFrame, group: str, k: int, measure: str, *tiebreak: str) -> DataFrame:
    """The k largest of each group. Spark turns the row-number filter into a
    group limit ahead of the shuffle, so a group of any size sends at most k
    rows per task."""
    w = Window.partitionBy(group).orderBy(*_order([f"-{measure}", *tiebreak]))
    return agg.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def _extreme(keys: Sequence[str], measure: Column, largest: bool, value: Column) -> Column:
    """Value of the row with the extreme measure; ties go to the first key,
    rows without the measure do not count."""
    place = F.struct(
        (-measure if largest else measure).alias("m"),
        *[p for k in keys for p in (F.col(k).isNull().alias(f"{k}_null"), F.col(k).alias(k))],
    )
    return F.min_by(value, F.when(measure.isNotNull(), place))


def row_at_max(agg: DataFrame, measure: str, *keys: str) -> DataFrame:
    row = _extreme(keys, F.col(measure), True, F.struct(*agg.columns))
    return agg.agg(row.alias("r")).filter("r is not null").select("r.*")


def row_at_min(agg: DataFrame, measure: str, *keys: str) -> DataFrame:
    row = _extreme(keys, F.col(measure), False, F.struct(*agg.columns))
    return agg.agg(row.alias("r")).filter("r is not null").select("r.*")


def highlights(
    agg: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, str]],
    group: str | None = None,
) -> DataFrame:
    """One row per highlight: its name, the key of the row that holds the
    extreme, and the extreme value. ``wanted`` maps a name to (measure, "max" or
    "min"). All of them come from one pass; an empty input has none."""
    picks = []
    for name, (measure, side) in wanted.items():
        m = as_col(measure)
        row = F.struct(
            F.lit(name).alias("highlight"),
            *[F.col(k) for k in keys],
            m.cast("double").alias("value"),
        )
        picks.append(_extreme(keys, m, side == "max", row))
    grouped = agg.groupBy(group) if group else agg.groupBy()
    rows = grouped.agg(F.array(*picks).alias("rows"))
    prefix = [group] if group and group not in keys else []
    return rows.select(*prefix, F.inline("rows")).filter(F.col("highlight").isNotNull())


def members_of_top(agg: DataFrame, key: str, k: int, measure: str) -> DataFrame:
    """All rows of the k keys with the largest total, for keys with a few rows
    each (such as one per year): a key's rows travel as one list, so the input
    is read once."""
    row = F.struct(*[c for c in agg.columns if c != key])
    per = agg.groupBy(key).agg(F.sum(measure).alias("_t"), F.collect_list(row).alias("_rows"))
    return top_k(per, k, "_t", key).select(key, F.inline("_rows"))


def best_and_worst(agg: DataFrame, measure: str, *keys: str) -> DataFrame:
    """First and last row by a measure, marked ``best`` and ``worst``."""
    row = F.struct(*agg.columns)
    sides = [
        F.struct(F.lit(side).alias("place"), _extreme(keys, F.col(measure), largest, row).alias("r"))
        for side, largest in (("best", True), ("worst", False))
    ]
    return (
        agg.agg(F.array(*sides).alias("rows"))
        .select(F.inline("rows"))
        .filter("r is not null")
        .select("place", "r.*")
    )


def top_keys(agg: DataFrame, name: str, k: int, measure: str) -> DataFrame:
    """The k values of a column with the largest total measure."""
    totals = agg.groupBy(name).agg(F.sum(measure).alias("_t"))
    return top_k(totals, k, "_t", name).select(name)


def trim_axes(
    agg: DataFrame, rows: tuple[str, int], cols: tuple[str, int], measure: str
) -> DataFrame:
    """Cells whose row is among the top rows and whose column among the top
    columns, by total measure. The two lists have a fixed length, so they are
    broadcast. Rows without a name on either axis are left out.

    The keys are unique, so an inner join filters like a semi join would; but it
    stays above the aggregation, and Spark runs the aggregation once for the
    cells and both lists.
    """
    agg = agg.filter(F.col(rows[0]).isNotNull() & F.col(cols[0]).isNotNull())
    out = agg
    for name, k in (rows, cols):
        out = out.join(F.broadcast(top_keys(agg, name, k, measure)), name)
    return out
