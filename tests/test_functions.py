"""Bands, calendar and measures on hand-worked values."""

import datetime as dt
from decimal import Decimal

import pytest
from sales_rows import sale
from pyspark.sql import functions as F

from tallygrove.functions import bands, calendar
from tallygrove.functions.measures import growth_pct
from tallygrove.operators import dimensions, enrich
from tallygrove.plans import api, exports


def values(spark, kind, items, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


AGES = [17, 18, 24, 25, 26, 35, 36, 40, 41, 55, 56, 65, 66, None]


def test_age_band6(spark):
    assert values(spark, "int", AGES, bands.age_band6) == [
        "Unknown", "18-25", "18-25", "18-25", "26-35", "26-35", "36-45", "36-45", "36-45",
        "46-55", "56-65", "56-65", "65+", "Unknown",
    ]


def test_age_band3(spark):
    young, middle, senior = "Under 25", "25-40", "41+"
    assert values(spark, "int", AGES, bands.age_band3) == (
        [young] * 3 + [middle] * 5 + [senior] * 5 + ["Unknown"]
    )


def test_age_band3n(spark):
    got = values(spark, "int", AGES, bands.age_band3n)
    assert [got[i] for i in (2, 3, 8, 13)] == [
        "1. Under 25", "2. 25 to 40", "3. 41 and above", "Unknown",
    ]


def test_career(spark):
    got = values(spark, "int", [24, 25, 40, 41, 55, 56, None], bands.career_segment)
    assert got == [
        "Young Adults (<25)", "Mid Career (25-40)", "Mid Career (25-40)", "Senior Career (41-55)",
        "Senior Career (41-55)", "Pre-Retirement (55+)", "Unknown Age",
    ]


def test_income_segment_has_a_gap(spark):
    incomes = ["29999.99", "30000", "60000", "60000.50", "60001", "100000", "100000.01", None]
    got = values(spark, "decimal(10,2)", [i and Decimal(i) for i in incomes], bands.income_segment)
    low, mid, upper, high, unknown = bands.INCOME_SEGMENTS
    assert got == [low, mid, mid, unknown, upper, upper, high, unknown]


def test_time_period(spark):
    got = values(spark, "int", [5, 6, 11, 12, 17, 18, 21, 22], bands.time_period)
    morning, noon, evening, night = bands.TIME_PERIODS
    assert got == [night, morning, morning, noon, noon, evening, evening, night]


def test_segment_order(spark):
    got = values(spark, "string", ["b", "a", "x"], lambda c: bands.segment_order(c, ["a", "b"]))
    assert got == [2, 1, 3]


@pytest.mark.parametrize("year, day", [(2023, 24), (2024, 22), (2025, 28)])
def test_november_friday(spark, year, day):
    out = spark.range(1).select(calendar.november_friday(F.lit(year))).first()[0]
    assert out == dt.date(year, 11, day)


@pytest.mark.parametrize(
    "day, period",
    [
        ("2025-11-28", "BLACKFRIDAY"), ("2025-12-01", "CYBERMONDAY"), ("2025-12-02", "CHRISTMAS"),
        ("2025-12-25", "CHRISTMAS"), ("2025-12-26", "NEWYEAR"), ("2025-12-31", "NEWYEAR"),
        ("2026-01-02", "NEWYEAR"), ("2026-01-03", None), ("2025-11-29", None), ("2025-07-01", None),
    ],
)
def test_discount_period(spark, day, period):
    out = spark.range(1).select(calendar.discount_period(F.lit(day).cast("date"))).first()[0]
    assert out == period


def test_closed_form_equals_calendar_table(spark):
    spine = dimensions.date_spine(spark, "1995-01-01", "2026-12-31", "day")
    days = spine.select(F.col("day").cast("timestamp_ntz").alias("date"))
    table = dimensions.discount_calendar(spark, 1995, 2027)
    a = enrich.enrich_discount(days).drop("discount_applied")
    b = enrich.enrich_discount(days, table).drop("discount_applied").select(a.columns)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_large_calendar_joins_without_broadcast(spark, make, monkeypatch):
    monkeypatch.setattr(enrich, "BROADCAST_ROWS", 3)
    df = make(sale(1, date=dt.datetime(2024, 12, 3)), sale(2))
    out = enrich.enrich_discount(df, dimensions.discount_calendar(spark, 2024, 2025))
    assert {r.transaction_id: r.discount_period for r in out.collect()} == {"1": "CHRISTMAS", "2": None}


def test_weekday_columns(spark, make):
    rows = enrich.enrich_calendar(
        make(sale(1, date=dt.datetime(2024, 3, 4, 23, 59)), sale(2, date=dt.datetime(2024, 12, 29)))
    )
    got = {r.transaction_id: r for r in rows.collect()}
    assert (got["1"].hour, got["1"].day_of_week, got["1"].day_of_week_text) == (23, 1, "MON")
    assert (got["2"].day_of_week, got["2"].day_of_week_text, got["2"].month_text) == (7, "SUN", "DEC")


def test_cyclic_features(spark, make):
    row = enrich.cyclic_features(enrich.enrich_calendar(make(sale(date=dt.datetime(2024, 3, 4))))).first()
    assert row.day_of_week_sin == pytest.approx(0.7818314824680298)
    assert row.day_of_week_cos == pytest.approx(0.6234898018587336)
    assert row.month_sin == pytest.approx(1.0) and row.month_cos == pytest.approx(0.0, abs=1e-12)


def test_valid_date(spark):
    texts = [
        "2024-01-31 23:59:59", "2024-01-31", "2024-1-5", "2024-02-30", "2024-13-01", "01/02/2024",
        "2024-01-31T10:00:00", "2024-01-31 25:00:00", "", None, "2024",
    ]
    got = values(spark, "string", texts, calendar.valid_date)
    assert got == [True, True, True] + [False] * 8


def test_growth(spark):
    df = spark.createDataFrame(
        [(1, 100, None), (2, 0, 0), (3, 5, 0), (4, 0, 50), (5, 75, 50)], "i int, cur int, prev int"
    )
    got = [r[0] for r in df.orderBy("i").select(growth_pct("cur", "prev")).collect()]
    assert got == [None, 0.0, 100.0, -100.0, 50.0]


def test_months_without_revenue(make):
    def month(m, amt):
        return sale(m, date=dt.datetime(2024, m, 5), amt=amt)

    df = enrich.enrich_sales(make(month(1, 0), month(2, 0), month(3, 8), month(4, 0), month(5, "2.50")))
    got = [r.revenue_change_pct for r in api.monthly_trends(df).collect()]
    assert got == [None, 0.0, 100.0, -100.0, 100.0]


def test_totals_do_not_overflow(make):
    df = make(*[sale(i, amt="99999999.99") for i in range(50)])
    out = exports.sales_by_country(enrich.enrich_sales(df))
    assert out.schema["total_revenue"].dataType.simpleString() == "decimal(38,2)"
    assert out.first().total_revenue == Decimal("4999999999.50")


def test_reports_on_an_empty_table(make):
    df = enrich.enrich_sales(make())
    summary = api.sales_summary(df).first()
    assert (summary.total_records, summary.total_revenue, summary.date_start) == (0, None, None)
    assert exports.key_metrics(df).first().avg_daily_revenue is None
    assert api.monthly_trends(df).count() == 0
    assert api.value_transactions(df).count() == 0
    assert api.sales_by_date(df, "2024-01-01").count() == 0
    assert exports.best_discount_period(df).count() == 0
