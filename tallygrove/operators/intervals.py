"""Rows and the time intervals they lie in: a range join without comparing every pair.

An interval is filed under the bins it touches, at the level whose bins are at least as
wide as it is long, so it touches two bins at most. A row lies in one bin of each level
that occurs; the equality of bins finds the candidates and the times decide. Levels double from
a second on, so there are 64 at most and a few in practice.

Few intervals: per level one list per bin, broadcast; a row looks up one list per level and is neither
copied nor shuffled. Many: the distinct times are given their bins and meet the intervals in a shuffle, in which
adaptive execution splits a bin that holds very many of them; rows then meet the intervals of their time. The rows are
not written, and join with the columns that are used later and no others. They are read twice, so their times must come out
the same both times.

An interval without a start or an end, or that ends before it starts, holds nothing. A
row without a time lies in none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.dimensions import BROADCAST_ROWS
from tallygrove.sources.stored import stored

_LEVELS = 50  # 2**50 seconds are longer than any span of timestamps


def _seconds(time: Column) -> Column:
    """Whole seconds since 1970 by the clock, whatever the session's time zone."""
    day = F.unix_date(F.to_date(time)).cast("bigint") * 86400
    return day + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def _binned(intervals: DataFrame, start: str, end: str, closed: bool) -> DataFrame:
    """(level, bin, the interval's columns), one row per touched bin."""
    valid = (F.col(start) <= F.col(end)) if closed else (F.col(start) < F.col(end))
    first, last = _seconds(F.col(start)), _seconds(F.col(end))
    rows = intervals.filter(valid).withColumn("_first", first).withColumn("_last", last)
    length = F.col("_last") - F.col("_first") + 1
    level = F.least(F.ceil(F.log2(length)), F.lit(_LEVELS)).cast("int")
    rows = rows.withColumn("_level", level)
    bins = F.sequence(F.call_function("shiftright", "_first", "_level"), F.call_function("shiftright", "_last", "_level"))
    return rows.withColumn("_bin", F.explode(bins)).drop("_first", "_last")


def _bin(time: Column, level: int) -> Column:
    return F.shiftright(_seconds(time), level)


def _inside(time: Column, start: Column, end: Column, closed: bool) -> Column:
    return (time >= start) & ((time <= end) if closed else (time < end))


def tag_first(
    df: DataFrame, intervals: DataFrame, prio: str, time: str = "date", start: str = "start_t", end: str = "end_t",
    closed: bool = True, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each row once, with the columns of the interval of lowest ``prio`` (then of the least columns, in
    their order) that holds its time; nulls if none does. ``closed``: the end belongs to the interval."""
    values = [c for c in intervals.columns if c not in (start, end)]
    place = F.struct(prio, *[c for c in values if c != prio], start, end)
    binned = stored(_binned(intervals, start, end, closed).select("_level", "_bin", place.alias("_i")), "intervals")
    levels, small = _measured(binned, broadcast_rows)
    kinds = {c: intervals.schema[c].dataType for c in values}
    if not levels:
        return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    if small:
        rows, held = _with_lists(df, binned, levels, time, start, end, closed)
        least = rows.withColumn("_held", F.array_min(held))
        return least.select(*df.columns, *[F.col("_held")[c].alias(c) for c in values])
    found = _matched(df, binned, levels, time, start, end, closed).groupBy("_time").agg(F.min("_i").alias("_held"))
    rows = df.join(stored(found, "interval-times"), F.col(time) == F.col("_time"), "left")
    return rows.select(*df.columns, *[F.col("_held")[c].alias(c) for c in values])


def tag_all(
    df: DataFrame, intervals: DataFrame, time: str = "date", start: str = "start_t", end: str = "end_t", closed: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """A row for each row and interval that holds its time, with the interval's columns; equal intervals
    count once each. Rows outside of all intervals are left out."""
    values = [c for c in intervals.columns if c not in (start, end)]
    place = F.struct(F.monotonically_increasing_id().alias("_id"), *values, start, end)
    binned = stored(_binned(intervals.select(place.alias("_i"), start, end), start, end, closed).select("_level", "_bin", "_i"), "intervals")
    levels, small = _measured(binned, broadcast_rows)
    if not levels:
        empty = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in values]
        return df.select("*", *empty).limit(0)
    if small:
        rows, held = _with_lists(df, binned, levels, time, start, end, closed)
        rows = rows.select(*df.columns, F.explode(held).alias("_i"))
    else:
        found = stored(_matched(df, binned, levels, time, start, end, closed), "interval-times")
        rows = df.join(found, F.col(time) == F.col("_time"))
    return rows.select(*df.columns, *[F.col("_i")[c].alias(c) for c in values])


def _measured(binned: DataFrame, limit: int) -> tuple[list[int], bool]:
    """The levels that occur, and whether the intervals are few enough to be broadcast."""
    counts = binned.groupBy("_level").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(r["_level"] for r in counts), sum(r["n"] for r in counts) <= limit


def _with_lists(
    df: DataFrame, binned: DataFrame, levels: list[int], time: str, start: str, end: str, closed: bool
) -> tuple[DataFrame, Column]:
    """``df`` with a list of intervals per level, and those of them that hold the row's time."""
    lists, rows = [], df
    for k in levels:
        of_level = binned.filter(F.col("_level") == k).groupBy("_bin").agg(F.collect_list("_i").alias(f"_list{k}"))
        rows = rows.withColumn("_bin", _bin(F.col(time), k)).join(F.broadcast(of_level), "_bin", "left").drop("_bin")
        lists.append(F.coalesce(f"_list{k}", F.array()))
    return rows, F.filter(F.concat(*lists), lambda i: _inside(F.col(time), i[start], i[end], closed))


def _matched(
    df: DataFrame, binned: DataFrame, levels: list[int], time: str, start: str, end: str, closed: bool
) -> DataFrame:
    """(_time, _i) of the times that occur and the intervals that share a bin with them and hold them."""
    bins = F.array(*[F.struct(F.lit(k).alias("_level"), _bin(F.col("_time"), k).alias("_bin")) for k in levels])
    times = df.select(F.col(time).alias("_time")).filter(F.col("_time").isNotNull()).distinct()
    dealt = times.select("_time", F.inline(bins))
    held = _inside(F.col("_time"), F.col("_i")[start], F.col("_i")[end], closed)
    return dealt.join(binned, ["_level", "_bin"]).filter(held).select("_time", "_i")
