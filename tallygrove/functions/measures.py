"""Aggregate expressions shared by the reports.

Sums of money and averages are exact: money is added as decimal and turned into
a double once, at the end, so a result does not depend on the order in which
partitions are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrove.schema import AMOUNT, TOTAL_TYPE


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_rows() -> Column:
    return F.count(F.lit(1))


def _wide(c: Column | str) -> Column:
    """A sum adds ten digits to its input's type, so this one has 38."""
    return as_col(c).cast("decimal(28,2)")


def total(c: Column | str = AMOUNT) -> Column:
    """Sum of a money column."""
    return F.sum(_wide(c)).cast(TOTAL_TYPE)


def total_int(c: Column | str) -> Column:
    return F.sum(as_col(c).cast("bigint"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` as double; null when ``b`` is zero."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def mean(c: Column | str = AMOUNT) -> Column:
    """Average of a decimal or integer column as double."""
    c = as_col(c)
    return ratio(F.sum(c), F.count(c))


def low(c: Column | str) -> Column:
    return F.min(as_col(c))


def high(c: Column | str) -> Column:
    return F.max(as_col(c))


_approximate: ContextVar[float | None] = ContextVar("approximate", default=None)


@contextmanager
def approximate(rsd: float = 0.01) -> Iterator[None]:
    """Reports built inside count distinct values approximately, with this
    relative standard deviation."""
    token = _approximate.set(rsd)
    try:
        yield
    finally:
        _approximate.reset(token)


def n_distinct(c: Column | str, approx: bool = False) -> Column:
    """Distinct non-null values, exact by default. ``approx`` (or building the
    report inside :func:`approximate`) takes a fixed-size sketch per group
    instead of a shuffle of (group, value) pairs."""
    c = as_col(c)
    rsd = _approximate.get() or (0.01 if approx else None)
    return F.approx_count_distinct(c, rsd) if rsd else F.count_distinct(c)


def active_days(c: Column | str = "date") -> Column:
    return F.count_distinct(F.to_date(as_col(c)))


def n_if(cond: Column | str) -> Column:
    """Number of rows for which the condition holds."""
    return F.count(F.when(as_col(cond), F.lit(1)))


def total_if(cond: Column | str, c: Column | str = AMOUNT) -> Column:
    return F.sum(F.when(as_col(cond), _wide(c))).cast(TOTAL_TYPE)


def mean_if(cond: Column | str, c: Column | str = AMOUNT) -> Column:
    return mean(F.when(as_col(cond), as_col(c)))


def percent(part: Column | str, whole: Column | str, digits: int | None = 2) -> Column:
    """``part`` as a percentage of ``whole``, rounded unless ``digits`` is None."""
    p = F.try_divide(as_col(part).cast("double") * 100.0, as_col(whole).cast("double"))
    return p if digits is None else F.round(p, digits)


def growth_pct(cur: Column | str, prev: Column | str) -> Column:
    """Change against the previous value in percent: null without a previous
    value; from zero it is 0 (still zero) or 100."""
    cur, prev = as_col(cur), as_col(prev)
    step = (cur - prev).cast("double") / prev.cast("double") * 100.0
    from_zero = F.when(cur == 0, 0.0).otherwise(100.0)
    return F.when(prev.isNotNull(), F.when(prev == 0, from_zero).otherwise(step))
