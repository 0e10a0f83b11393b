"""Calendar expressions over a timestamp or date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrove.functions.measures import as_col

# Labels of the calendar columns, in natural order.
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# Discount period names; the first one that covers a day wins.
DISCOUNT_PERIODS = ["BLACKFRIDAY", "CYBERMONDAY", "NEWYEAR", "CHRISTMAS"]


def _label(names: list[str], number: Column) -> Column:
    """Name number 1, 2, ... of a list; a constant array, no date formatting."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), number)


def day_of_week(c: Column | str) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return (F.weekday(as_col(c)) + 1).cast("int")


def day_number(c: Column | str) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(as_col(c)) - 1).cast("bigint")


def weekday_text(number: Column | str) -> Column:
    return _label(WEEKDAYS, as_col(number))


def weekday_name(number: Column | str) -> Column:
    return _label(WEEKDAY_NAMES, as_col(number))


def month_text(number: Column | str) -> Column:
    return _label(MONTHS, as_col(number))


def month_name(number: Column | str) -> Column:
    return _label(MONTH_NAMES, as_col(number))


def month_start(c: Column | str) -> Column:
    return F.trunc(F.to_date(as_col(c)), "MM")


def is_weekend(c: Column | str) -> Column:
    return F.weekday(as_col(c)) >= 5


def cyclic(number: Column | str, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = F.lit(2.0) * F.pi() * as_col(number) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def november_friday(year: Column | str) -> Column:
    """The fourth Friday of November."""
    first = F.make_date(as_col(year), F.lit(11), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(4) - F.weekday(first), F.lit(7)) + 21)


def discount_period(c: Column | str) -> Column:
    """Name of the discount period a sale date falls in, or null.

    The standard calendar depends on the date alone, so tagging needs no join:
    this is the closed form of looking the day up in
    :func:`tallygrove.operators.dimensions.discount_calendar`.
    """
    day = F.to_date(as_col(c))
    month, dom = F.month(day), F.dayofmonth(day)
    friday = november_friday(F.year(day))
    from_november = month >= 11
    return (
        F.when(from_november & (day == friday), "BLACKFRIDAY")
        .when(from_november & (day == F.date_add(friday, 3)), "CYBERMONDAY")
        .when(((month == 12) & (dom >= 26)) | ((month == 1) & (dom <= 2)), "NEWYEAR")
        .when((month == 12) & (dom <= 26), "CHRISTMAS")
    )


# Accepted date texts, as patterns (four-digit year, one or two
# digits for the rest).
TIMESTAMP_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$"


def parse_timestamp(c: Column | str, pattern: str = TIMESTAMP_PATTERN) -> Column:
    """Text of exactly this form as timestamp, else null; no time zone takes
    part."""
    c = as_col(c)
    return F.when(c.rlike(pattern), c.try_cast("timestamp_ntz"))


def parse_date(c: Column | str) -> Column:
    """Text as timestamp: date and time, or date only; null when neither."""
    return F.coalesce(parse_timestamp(c), parse_timestamp(c, DATE_PATTERN))


def valid_date(c: Column | str) -> Column:
    return parse_date(c).isNotNull()
