"""Orderings, windows, order statistics, filters, cleaning, dimensions."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from sales_rows import sale
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallygrove.operators import clean, dimensions, enrich, filters, groups, lookup, order_stats, ranking
from tallygrove.plans import api, exports, retail, summary
from tallygrove.plans.registry import REPORTS
from tallygrove.schema import AMOUNT, MONTH_PARTITION, SALES_COLUMNS


def reference_tiles(rows, n):
    """Plain ntile in Python over (amount, nulls last; tie key) order."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q, r = divmod(len(ordered), n)
    out, start = [], 0
    for tile in range(1, n + 1):
        size = q + (1 if tile <= r else 0)
        out += [(row, tile) for row in ordered[start : start + size]]
        start += size
    return out


def check_tiles(spark, items, n=10):
    """items: (amount in cents or None, id). Copies may share an id."""
    rows = [(None if a is None else Decimal(a) / 100, str(i)) for a, i in items]
    df = spark.createDataFrame(rows, "amt decimal(10,2), id string")
    got = order_stats.with_tile(df, "amt", ["id"], n, "t")
    keys = {r.id: r.k for r in df.select("id", order_stats.tie_key(["id"]).alias("k")).distinct().collect()}
    want = reference_tiles([(a, keys[i], i) for a, i in rows], n)
    assert Counter((r.amt, r.id, r.t) for r in got.collect()) == Counter(
        (row[0], row[2], tile) for row, tile in want
    )


@pytest.mark.parametrize(
    "items",
    [
        [],
        [(5, 1)],
        [(i, i) for i in range(7)],
        [(100, i) for i in range(1000)],
        [(i % 3 * 50, i) for i in range(500)],
        [(100 if i % 3 else i, i) for i in range(900)],
        [(None if i % 2 else i, i) for i in range(300)],
        [(None, i) for i in range(25)],
        [(-i, i) for i in range(200)],
        [(5, 1)] * 333 + [(i, i) for i in range(2, 400)],
        [(5, 1)] * 1000,
    ],
    ids=["none", "one", "seven", "equal", "three", "hot", "nulls", "all_null", "negative", "copies", "only_copies"],
)
def test_tiles(spark, items):
    check_tiles(spark, items)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.integers(-50, 50)), st.integers(0, 30)), max_size=120),
    st.integers(2, 12),
)
def test_tiles_of_any_rows(spark, items, n):
    check_tiles(spark, items, n)


@pytest.mark.parametrize("few", [0, 2, 30])
def test_tiles_with_many_passes(spark, monkeypatch, few):
    monkeypatch.setattr(order_stats, "FANOUT", 3)
    monkeypatch.setattr(order_stats, "FEW_ROWS", few)
    monkeypatch.setattr(order_stats, "_COPIES_PER_STEP", 7)
    check_tiles(spark, [(i * 7919 % 1000, i) for i in range(60)] + [(10**9, 7)] * 40)


def test_outer_deciles(make):
    rows = make(*[sale(i, amt=i) for i in range(25)])
    both = order_stats.with_outer_deciles(rows).join(
        order_stats.with_decile(rows).select("transaction_id", "value_decile"), "transaction_id"
    )
    for r in both.collect():
        assert r.value_group == (1 if r.value_decile == 1 else 3 if r.value_decile == 10 else 2)
    few = order_stats.with_outer_deciles(make(*[sale(i, amt=i) for i in range(7)]))
    assert Counter(r.value_group for r in few.collect()) == {1: 1, 2: 6}


@pytest.mark.parametrize("amounts, want", [([], None), ([3], 3.0), ([1, 2], 1.5), ([9, 1, 5, None], 5.0)])
def test_median(make, amounts, want):
    df = make(*[sale(i, total_amount_per_product_sgd=a and Decimal(a)) for i, a in enumerate(amounts)])
    assert order_stats.median(df) == want


def test_medians_share_their_jobs(spark, make):
    df = make(*[sale(i, amt=i * 7 % 5 + 1, age=None if i % 3 else i, income=None) for i in range(30)])
    sc = spark.sparkContext
    sc.setJobGroup("medians", "medians")
    try:
        got = order_stats.medians(df, ["total_amount_per_product_sgd", "age", "income"])
    finally:
        sc._jsc.sc().clearJobGroup()
    assert got == {"total_amount_per_product_sgd": 3.0, "age": 13.5, "income": None}
    assert len(sc.statusTracker().getJobIdsForGroup("medians")) <= 6


def test_rank_leaves_gaps(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "k string, v int")
    got = {r.k: r.place for r in ranking.with_rank(df, "v", "place").collect()}
    assert got == {"b": 1, "a": 2, "c": 2, "d": 4}


def test_rank_of_many_values_nulls_and_nothing(spark):
    values = [(i * 37 % 50) or None for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v int")
    got = {r.k: r.place for r in ranking.with_rank(df, "v", "place").collect()}
    assert got == {k: 1 + sum(w is not None and (v is None or w > v) for w in values) for k, v in enumerate(values)}
    assert ranking.with_rank(df.limit(0), "v").count() == 0


def test_geographic_ranks_ties(make):
    rows = [sale(i, country=c, amt=a) for i, (c, a) in enumerate([("A", 5), ("B", 9), ("C", 5), ("D", 1)])]
    out = api.geographic_distribution(make(*rows), 3).collect()
    assert [(r.country, r.revenue_rank) for r in out] == [("B", 1), ("A", 2), ("C", 2)]


def test_extremes_take_the_first_key_on_a_tie(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1), ("d", 1), ("e", None)], "k string, v int")
    assert ranking.row_at_max(df, "v", "k").first().k == "a"
    assert ranking.row_at_min(df, "v", "k").first().k == "c"
    out = ranking.highlights(df, ["k"], {"hi": ("v", "max"), "lo": ("v", "min")}).collect()
    assert {(r.highlight, r.k, r.value) for r in out} == {("hi", "a", 5.0), ("lo", "c", 1.0)}
    assert ranking.highlights(df.limit(0), ["k"], {"hi": ("v", "max")}).count() == 0


def test_highlights_per_group(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "c", 3)], "g string, k string, v int")
    out = ranking.highlights(df, ["k"], {"hi": ("v", "max")}, group="g").collect()
    assert {(r.g, r.k, r.value) for r in out} == {("x", "b", 2.0), ("y", "c", 3.0)}


def test_top_k_per_group_and_ties(spark):
    df = spark.createDataFrame(
        [("x", "b", 5), ("x", "a", 5), ("x", "c", 9), ("y", "d", 1)], "g string, k string, v int"
    )
    out = ranking.top_k_per_group(df, "g", 2, "v", "k").collect()
    assert {(r.g, r.k) for r in out} == {("x", "c"), ("x", "a"), ("y", "d")}


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert [r.v for r in ranking.order_by(df, "v").collect()] == [1, 2, None]
    assert [r.v for r in ranking.order_by(df, "-v").collect()] == [2, 1, None]


def test_pages_by_key_follow_each_other(make):
    df = make(*[sale(i, date=dt.datetime(2024, 1, 1 + i % 4), product_id=str(i % 3)) for i in range(23)])
    whole, last, pages = [], None, []
    for n in range(1, 7):
        pages.append(ranking.page(df, n, 5).collect())
        step = ranking.page_after(df, last, 5).collect()
        assert step == pages[-1]
        whole += step
        last = step[-1].asDict() if step else last
    assert len(whole) == 23 and len({r.transaction_id for r in whole}) == 23


def test_pages_of_a_partitioned_table(make):
    df = make(*[sale(i, date=dt.datetime(2024, 1 + i % 6, 1 + i % 9)) for i in range(42)], sale(98, date=None), sale(99, date=None))
    parted = df.withColumn(MONTH_PARTITION, F.trunc(F.to_date("date"), "MM"))
    for n in range(1, 6):
        want = ranking.page(df, n, 9).collect()
        assert ranking.page(parted, n, 9).select(SALES_COLUMNS).collect() == want
        after = ranking.page_after(parted, want[-1].asDict(), 9).select(SALES_COLUMNS).collect()
        assert after == ranking.page(df, n + 1, 9).collect()
    assert ranking.sample(parted, 11).collect() == ranking.sample(df, 11).collect()


def test_pages_show_every_copy(make):
    """Full copies across the edge of a page."""
    rows = [sale(i // 7, date=dt.datetime(2024, 1, 5)) for i in range(21)] + [sale(50, product_name=n) for n in "ab"]
    df, last, shown, whole = make(*rows), None, 0, []
    for _ in range(12):
        step = [r.asDict() for r in ranking.page_after(df, last, 2, shown).collect()]
        if step:
            shown = ranking.copies_shown(step, step[-1], shown if step[-1] == last else 0)
            last = step[-1]
        whole += step
    assert Counter(map(str, whole)) == Counter(str(r.asDict()) for r in df.collect())


def test_deep_pages_sort_few_rows(make):
    df = make(*[sale(i, date=dt.datetime(2024, 1 + i % 12, 1 + i % 25)) for i in range(300)])
    parted = df.withColumn(MONTH_PARTITION, F.trunc(F.to_date("date"), "MM"))
    rows, skip = ranking._around(parted, 200, 5)
    assert rows.count() < 30 and skip < 30
    assert ranking._around(parted, 400, 5)[0].count() == 0
    assert ranking.page(parted, 41, 5).select(SALES_COLUMNS).collect() == ranking.page(df, 41, 5).collect()


@pytest.mark.parametrize("number, size", [(0, 10), (1, 0), (1, 1001)])
def test_bad_pages(make, number, size):
    with pytest.raises(ValueError):
        ranking.page(make(sale()), number, size)


def test_matrix_fills_gaps_and_keeps_empty_rows(make):
    rows = [
        sale(1, product_name="a", country="X", amt=5), sale(2, product_name="b", country="Y", amt=4),
        sale(3, product_name="b", country="Z", amt=1), sale(4, product_name="c", country="Z", amt=2),
    ]
    df = enrich.enrich_sales(make(*rows))
    out = summary.product_country_matrix(df, 2020, products=3, countries=2).collect()
    got = {(r.product_name, r.country): r.total_sales for r in out}
    assert got == {
        ("a", "X"): 5, ("a", "Y"): 0, ("b", "X"): 0, ("b", "Y"): 4, ("c", "X"): 0, ("c", "Y"): 0,
    }
    wide = {r.product_name: r for r in summary.product_country_pivot(df, 2020, 3, 2).collect()}
    assert (wide["b"].X, wide["b"].Y, wide["c"].X) == (0, 4, 0)


def test_shares(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 3), ("y", "c", 5)], "g string, k string, v bigint")
    got = {r.k: (r.s, r.t) for r in groups.share_of_group(df, "g", "v", "s", "t").collect()}
    assert got == {"a": (25.0, 4), "b": (75.0, 4), "c": (100.0, 5)}
    got = {r.k: r.s for r in groups.share_of_total(df, "v", "s").collect()}
    assert got == {"a": 11.11, "b": 33.33, "c": 55.56}


def test_end_of_range_is_midnight(make):
    df = make(
        sale(1, date=dt.datetime(2024, 1, 1)), sale(2, date=dt.datetime(2024, 1, 2)),
        sale(3, date=dt.datetime(2024, 1, 2, 0, 0, 1)),
    )
    assert filters.date_range(df, "2024-01-01", "2024-01-02").count() == 2
    assert filters.date_range(df, "2024-01-01", "2024-01-02", end_inclusive=True).count() == 3
    assert filters.on_day(df, dt.date(2024, 1, 2)).count() == 2
    assert filters.from_year(df, 2025).count() == 0


def test_income_report_falls_back_to_age(make):
    df = make(sale(1, age=20), sale(2, age=60), sale(3, age=None))
    out = api.income_levels(df.drop("income")).collect()
    assert [r.income_segment for r in out] == ["Young Adults (<25)", "Pre-Retirement (55+)", "Unknown Age"]


def test_receipt_header_is_that_of_the_first_item(make):
    df = make(
        sale(1, receipt_number="9", product_name="Zip", customer_id="z"),
        sale(2, receipt_number="9", product_name="Ant", customer_id="a"),
        sale(3),
    )
    out = api.receipt_items(df, 9).collect()
    assert [(r.product_name, r.customer_id) for r in out] == [("Ant", "a"), ("Zip", "a")]
    assert api.receipt_items(df, "no such").count() == 0


def test_unknown_customer_has_no_row(make):
    assert api.customer_totals(make(sale()), "nobody").count() == 0


def test_approximate_variants(make):
    from tallygrove.functions.measures import approximate, n_distinct
    from tallygrove.plans import insights

    df = enrich.enrich_sales(make(*[sale(i, customer_id=str(i), amt=i + 1) for i in range(99)]))
    assert abs(df.agg(n_distinct("customer_id", approx=True)).first()[0] - 99) <= 5
    with approximate(0.02):
        rough = insights.kpis(df)
    assert "approx_count_distinct" in rough._jdf.queryExecution().analyzed().toString()
    assert abs(rough.first().total_customers - 99) <= 8
    assert insights.kpis(df).first().total_customers == 99
    assert insights.value_stats(df, approx=True).first().median_transaction == 50.0


# --- cleaning --------------------------------------------------------------


def test_missing_columns_get_defaults(spark):
    df = spark.createDataFrame([("7",)], "age string")
    out = clean.ensure_columns(df)
    assert out.columns == SALES_COLUMNS
    assert out.first().city == "default_city" and out.first().age == "7"
    typed = clean.sanitize_sales(out).first()
    assert typed.date is None and typed.age == 7 and typed.income == 0 and typed.city == "default_city"


def test_lenient_int(spark):
    texts = ["12", "12.7", " 5 ", "", "x", "-3", "+4", "1e2", "99999999999", "2.5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(clean.lenient_int(F.col("t"))).collect()]
    assert got == [12, 13, 5, None, None, -3, 4, 100, None, 3, None]


def test_reset_amounts(make):
    row = clean.sanitize_sales(make(sale(amt=5)), reset_amounts=True).first()
    assert row[AMOUNT] == 0 and row.unit_price_sgd == 0 and row.income == Decimal("40000.00")


def test_strict_typing_fails_on_a_bad_value(make):
    staged = clean.stage_as_strings(make(sale())).withColumn("age", F.lit("old"))
    with pytest.raises(PySparkException):
        clean.typed_from_staging(staged).collect()


def test_type_map_file(spark, tmp_path):
    path = tmp_path / "types.json"
    path.write_text('{"start_time": "character", "n": "integer 4", "x": "float", "gone": "float"}')
    df = spark.createDataFrame(
        [("2024-01-02 03:04:05", "5", "2.5", "q"), ("2024-01-02", "5.5", "two", "r")],
        "start_time string, n string, x string, rest string",
    )
    out = clean.apply_json_map(df, str(path)).collect()
    assert out[0] == (dt.datetime(2024, 1, 2, 3, 4, 5), 5, 2.5, "q")
    assert out[1] == (None, None, None, "r")


# --- dimensions ------------------------------------------------------------


def test_upsert(spark):
    kind = "key string, value string"
    base = spark.createDataFrame([("a", "1"), ("b", "2")], kind)
    new = spark.createDataFrame([("b", "9"), ("c", "3")], kind)
    out = dimensions.upsert_by_key(base, new, "key").collect()
    assert {tuple(r) for r in out} == {("a", "1"), ("b", "9"), ("c", "3")}


def test_upsert_keeps_one_row_per_key(spark):
    kind = "key string, value string, at int"
    base = spark.createDataFrame([("a", "1", 1), ("a", "2", 0), (None, "n", 1)], kind)
    new = spark.createDataFrame([("b", "1", 2), ("b", "9", 1), (None, "m", 0), (None, "k", 3)], kind)
    out = dimensions.upsert_by_key(base, new, "key", ["at"]).collect()
    assert {tuple(r) for r in out} == {("a", "1", 1), ("b", "1", 2), (None, "k", 3)}


def test_country_codes(spark):
    codes = spark.createDataFrame([("SG", "Singapore")], "code string, country string")
    assert tuple(dimensions.country_code_parameters(codes).first()) == (
        "countries_SG", "character 2", "SG", "Singapore",
    )


def test_geo_keeps_every_sale_once(spark, make):
    cities = spark.createDataFrame(
        [("Arbor", "Aland", 7), ("Arbor", "Other", 9)], "name string, country string, country_id int"
    )
    out = dimensions.enrich_geo(make(sale(1), sale(2, city="Nowhere")), cities).orderBy("transaction_id").collect()
    assert [(r.country, r.country_id) for r in out] == [("Aland", "7"), (None, None)]


def test_geo_of_a_list_too_large_to_broadcast(spark, make, monkeypatch):
    cities = spark.createDataFrame([("Arbor", "Aland", "7"), ("Brook", "Bland", "8")], "name string, country string, country_id string")
    sales = make(*[sale(i, city="Arbor") for i in range(100)], sale(200, city="Brook"), sale(201, city=None))
    want = sorted(map(str, dimensions.enrich_geo(sales, cities).collect()))
    monkeypatch.setattr(dimensions, "BROADCAST_ROWS", 1)
    out = dimensions.enrich_geo(sales, cities)
    assert sorted(map(str, out.select(dimensions.enrich_geo(sales, cities).columns).collect())) == want


def test_days_outside_the_range_stay(spark):
    daily = spark.createDataFrame([(dt.date(2002, 1, 1), 5, None), (dt.date(2001, 1, 1), 1, 2), (None, 3, 3)], "sale_date date, n bigint, m int")
    out = dimensions.fill_missing_days(daily, "2001-01-01", "2001-01-03")
    assert Counter((str(r.sale_date), r.n, r.m) for r in out.collect()) == Counter(
        [("2001-01-01", 1, 2), ("2001-01-02", 0, 0), ("2001-01-03", 0, 0), ("2002-01-01", 5, None), ("None", 3, 3)]
    )
    assert dimensions.fill_missing_days(daily).count() == 367
    assert dimensions.fill_missing_days(daily.limit(0)).count() == 0


def test_missing_days_are_filled(spark):
    daily = spark.createDataFrame([(dt.date(2024, 2, 28), 4)], "sale_date date, n bigint")
    out = dimensions.fill_missing_days(daily, "2024-02-27", "2024-03-01").orderBy("sale_date").collect()
    assert [r.n for r in out] == [0, 4, 0, 0]


def test_weekday_split_and_registry():
    assert len(REPORTS) >= 117
    assert {"monthly_trends", "value_transactions", "age_country_matrix"} <= set(REPORTS)


def test_probe_counts(make):
    df = enrich.enrich_sales(
        make(sale(1, date=dt.datetime(2024, 1, 1, 12)), sale(2, age=50, income=Decimal("60000")), sale(3, gender="M"))
    )
    row = exports.index_probe_counts(df).first()
    assert (row.first_day, row.age_25_40, row.income_above_50k, row.female, row.hour_12) == (1, 2, 1, 2, 1)


def test_top3_per_age_group(make):
    rows = [sale(i, age=a, product_id=str(p), product_name=f"n{p}", amt=p + 1)
            for i, (a, p) in enumerate((a, p) for a in (20, 30, None) for p in range(5))]
    out = retail.top3_products_by_age(enrich.enrich_sales(make(*rows))).collect()
    assert [(r.age_group, r.product_name) for r in out] == [
        ("1. Under 25", "n4"), ("1. Under 25", "n3"), ("1. Under 25", "n2"),
        ("2. 25 to 40", "n4"), ("2. 25 to 40", "n3"), ("2. 25 to 40", "n2"),
    ]


def hot_items(n):
    """Half of the rows share two amounts, a tenth has none, some are copies of one another."""
    amounts = [5000 if i % 4 == 0 else 7000 if i % 4 == 1 else None if i % 10 == 2 else i * 7919 % 10007 for i in range(n)]
    return [(a, i % (n // 2) if i % 5 == 0 else i) for i, a in enumerate(amounts)]


@pytest.mark.parametrize("sketch, fanout", [(10_000, 4096), (200, 50), (7, 4096)])
def test_tiles_by_the_sketch(spark, monkeypatch, sketch, fanout):
    """Very common values are counted by slices; a coarse sketch costs scans and changes nothing."""
    monkeypatch.setattr(order_stats, "SKETCH", sketch)
    monkeypatch.setattr(order_stats, "FANOUT", fanout)
    monkeypatch.setattr(order_stats, "FEW_ROWS", 40)
    check_tiles(spark, hot_items(12_000))
    check_tiles(spark, [(i * 7919 % 10007, i) for i in range(9_000)], 7)
    check_tiles(spark, [(None if i % 3 else -i, i) for i in range(6_000)], 4)
    check_tiles(spark, [(5, 1)] * 3000 + [(9, i) for i in range(3000)])


def test_a_missed_boundary_is_found_in_the_table(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "FEW_ROWS", 40)
    monkeypatch.setattr(order_stats, "_brackets", lambda values, lo, hi: [order_stats._Bracket(10, 20, frozenset([10]))])
    check_tiles(spark, hot_items(2_000))
    df = spark.createDataFrame([(i * 7 % 1001,) for i in range(2_000)], "n int")
    assert order_stats.median(df, "n") == sorted(i * 7 % 1001 for i in range(2_000))[999]


def test_medians_by_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "FEW_ROWS", 40)
    rows = [(i * 7919 % 10007 if i % 3 else None, 5 if i % 2 else i, -i) for i in range(9_001)]
    got = order_stats.medians(spark.createDataFrame(rows, "a int, b bigint, c int"), ["a", "b", "c"])
    for name, column in zip("abc", zip(*rows)):
        v = sorted(x for x in column if x is not None)
        assert got[name] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_tiles_scan_the_table_twice(spark, monkeypatch):
    """Beside the counts, which are small: a sketch and one count."""
    monkeypatch.setattr(order_stats, "FEW_ROWS", 40)
    seen = []
    real = order_stats.stored
    monkeypatch.setattr(order_stats, "stored", lambda df, name: seen.append(name) or real(df, name))
    tables = []
    real_pass = order_stats._count_pass
    monkeypatch.setattr(order_stats, "_count_pass", lambda df, *a: tables.append(df.columns) or real_pass(df, *a))
    df = spark.createDataFrame([(i, i) for i in range(20_000)], "amt int, id int")
    order_stats.with_tile(df, "amt", ["id"], 10, "t")
    assert seen == ["tile-counts"] and all("n" in columns for columns in tables)
    seen.clear()
    order_stats.with_tile(spark.createDataFrame([(i % 3, i) for i in range(20_000)], "amt int, id int"), "amt", ["id"], 10, "t")
    assert seen == ["tile-counts", "slice-counts"]


@pytest.mark.parametrize("limit", [100, 0])
def test_lookup_with_a_hot_key(spark, limit):
    """A third of the rows share a key and some have none; with and without a broadcast."""
    rows = [("hot" if i % 3 == 0 else None if i % 11 == 1 else f"k{i % 1500}", i) for i in range(6_000)]
    df = spark.createDataFrame(rows, "key string, i int")
    entries = [(f"k{i}", i, "x") for i in range(0, 3000, 2)] + [("hot", -1, None)]
    table = spark.createDataFrame(entries, "key string, v int, t string")
    got = lookup.lookup_join(df, table, "key", limit * 100)
    known = {k: (v, t) for k, v, t in entries}
    assert Counter(map(tuple, got.select("key", "i", "v", "t").collect())) == Counter((k, i, *known.get(k, (None, None))) for k, i in rows)
    assert [r["key"] for r in lookup.heavy_keys(df, "key").collect()] == ["hot"]
    if not limit:
        text = got._jdf.queryExecution().executedPlan().toString()
        anti = text.index("LeftAnti")
        assert "Exchange hashpartitioning(key" in text[:anti] and "LeftSemi" in text


def test_lookup_in_an_empty_table(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "key string, i int")
    for limit in (10, -1):
        got = lookup.lookup_join(df, spark.createDataFrame([], "key string, v int"), "key", limit)
        assert Counter(map(tuple, got.select("key", "i", "v").collect())) == Counter([("a", 1, None), (None, 2, None)])
        assert lookup.lookup_join(df.limit(0), spark.createDataFrame([("a", 1)], "key string, v int"), "key", limit).count() == 0
