"""Segments of age, income and hour, and the order in which they are listed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrove.functions.measures import as_col

# Segment labels, in listing order.
AGE_BANDS_6 = ["18-25", "26-35", "36-45", "46-55", "56-65", "65+", "Unknown"]
AGE_BANDS_3 = ["Under 25", "25-40", "41+", "Unknown"]
AGE_BANDS_3N = ["1. Under 25", "2. 25 to 40", "3. 41 and above", "Unknown"]
INCOME_SEGMENTS = [
    "Low Income (< 30k)",
    "Middle Income (30k-60k)",
    "Upper Middle (60k-100k)",
    "High Income (>100k)",
    "Unknown",
]
CAREER_SEGMENTS = [
    "Young Adults (<25)",
    "Mid Career (25-40)",
    "Senior Career (41-55)",
    "Pre-Retirement (55+)",
    "Unknown Age",
]
TIME_PERIODS = [
    "Morning (06:00-11:59)",
    "Afternoon (12:00-17:59)",
    "Evening (18:00-21:59)",
    "Late Night (22:00-05:59)",
]

Bounds = tuple[float | None, float | None]


def _banded(c: Column | str, bounds: list[Bounds], labels: list[str]) -> Column:
    """First label whose closed interval holds the value; the last label for
    anything else, null included."""
    c = as_col(c)
    out = None
    for (lo, hi), label in zip(bounds, labels):
        cond = F.lit(True)
        if lo is not None:
            cond = c >= lo
        if hi is not None:
            cond = (c <= hi) if lo is None else cond & (c <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(labels[-1])


def age_band6(c: Column | str = "age") -> Column:
    bounds = [(18, 25), (26, 35), (36, 45), (46, 55), (56, 65), (66, None)]
    return _banded(c, bounds, AGE_BANDS_6)


def age_band3(c: Column | str = "age") -> Column:
    return _banded(c, [(None, 24), (25, 40), (41, None)], AGE_BANDS_3)


def age_band3n(c: Column | str = "age") -> Column:
    return _banded(c, [(None, 24), (25, 40), (41, None)], AGE_BANDS_3N)


def income_segment(c: Column | str = "income") -> Column:
    """Incomes strictly between 60,000 and 60,001 belong to no segment and
    come out as 'Unknown', like missing ones."""
    c = as_col(c)
    low, middle, upper, high, unknown = INCOME_SEGMENTS
    return (
        F.when(c < 30000, low)
        .when(c.between(30000, 60000), middle)
        .when(c.between(60001, 100000), upper)
        .when(c > 100000, high)
        .otherwise(unknown)
    )


def career_segment(c: Column | str = "age") -> Column:
    bounds = [(None, 24), (25, 40), (41, 55), (56, None)]
    return _banded(c, bounds, CAREER_SEGMENTS)


def time_period(c: Column | str = "hour") -> Column:
    return _banded(c, [(6, 11), (12, 17), (18, 21)], TIME_PERIODS)


def segment_order(c: Column | str, labels: list[str]) -> Column:
    """Position of a label in its list; unlisted labels sort last."""
    c = as_col(c)
    out = F.when(c == labels[0], 1)
    for i, label in enumerate(labels[1:], 2):
        out = out.when(c == label, i)
    return out.otherwise(len(labels) + 1)
