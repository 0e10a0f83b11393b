"""Daily cells and look-up copies: what they hold, and what they read."""

import datetime as dt
import glob
import re
from collections import Counter

import pytest
from sales_rows import sale

from tallygrove.operators import enrich
from tallygrove.plans import api, cells, registry, summary
from tallygrove.schema import SALES_COLUMNS
from tallygrove.sources import copies, sinks


@pytest.fixture()
def rows(make):
    out = []
    for i in range(400):
        date = None if i % 50 == 7 else dt.datetime(2023 + i % 2, 1 + i % 12, 1 + i % 28, i % 24)
        out.append(sale(
            i, date=date, amt=f"{i % 90}.{i % 10}0", customer_id=f"c{i % 37}", age=None if i % 11 == 0 else 15 + i % 60,
            transaction_desc=["Product Sale", "Product Sale", "Product Refund"][i % 3], product_name=f"p{i % 5}", country=f"k{i % 4}",
            receipt_number=str(i // 2),
        ))
    return make(*out)


def listed(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


def check(table, rows):
    """All reports from cells equal the exact ones; few customers are counted exactly."""
    df, kept = enrich.enrich_sales(rows), cells.daily_cells(table).read()
    assert listed(cells.hourly_distribution(kept)) == listed(api.hourly_distribution(df))
    assert listed(cells.yearly_customers(kept)) == listed(summary.yearly_customers(df))
    for name, report in registry.EXPORT_BUNDLE.items():
        assert listed(cells.BUNDLE[name](kept)) == listed(report(df)), name


def test_cells_of_chunks(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    kept = cells.daily_cells(table)
    assert kept.read().count() == 0
    table.append(rows.filter("transaction_id % 2 = 0"), "a")
    assert len(kept.refresh()) == 1 and kept.refresh() == []
    table.append(rows.filter("transaction_id % 2 = 1").limit(20), "b")
    table.append(rows.filter("transaction_id % 2 = 1"), "b")
    assert len(kept.refresh()) == 1
    check(table, rows)


def test_cells_after_corrections(spark, rows, tmp_path):
    """Folders that were rewritten drop out of the cells, the others' cells stay as they are."""
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.append(rows, "a")
    cells.daily_cells(table).refresh()
    before = set(glob.glob(f"{tmp_path}/t/_cells/*/*.parquet"))
    changed = rows.filter("transaction_id IN ('3', '7', '201')").withColumn("age", rows["age"] + 1)
    table.upsert(changed, ["transaction_id"])
    ids = ["3", "7", "201"]
    want = rows.filter(~rows["transaction_id"].isin(ids)).unionByName(changed)
    check(table, want)
    assert before < set(glob.glob(f"{tmp_path}/t/_cells/*/*.parquet"))


def test_reports_from_cells_read_no_sales(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.append(rows, "a")
    kept = cells.daily_cells(table).read()
    for report in [cells.hourly_distribution, cells.yearly_customers, *cells.BUNDLE.values()]:
        assert all("/_cells/" in f for f in report(kept).inputFiles())
    written = cells.export_bundle(kept, str(tmp_path / "bundle"))
    assert sorted(written) == sorted(registry.EXPORT_BUNDLE) and all(glob.glob(f"{p}/part-*.csv") for p in written.values())


def test_cells_take_one_scan(rows):
    plan = cells.build(rows, [])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan", plan)) == 1


def test_sketches_are_close(spark, make):
    """Some ten thousand customers, in sketches of many days."""
    base = make(sale(1))
    many = spark.range(60_000).selectExpr(
        "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 300 AS INT)) AS d", "CAST(id * 7919 % 20011 AS STRING) AS c", "CAST(id AS STRING) AS t"
    )
    rows = many.crossJoin(base).withColumns({"date": many["d"], "customer_id": many["c"], "transaction_id": many["t"]}).select(SALES_COLUMNS)
    got = cells.yearly_customers(cells.build(rows, [])).first()["unique_customers"]
    want = rows.select("customer_id").distinct().count()
    assert abs(got - want) <= 0.02 * want


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_lookup_reads_one_bucket(spark, rows, tmp_path, adaptive):
    path = str(tmp_path / "copy")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        copy = copies.write_copy(rows, path, "customer_id", 16)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert listed(copy) == listed(rows)
    totals = api.customer_totals(copy, "c5")
    assert listed(totals) == listed(api.customer_totals(rows, "c5"))
    again = copies.open_copy(spark, path)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # prunes as well, but does not say so
    for report in (api.customer_totals, api.customer_recent):
        spark.conf.set(auto, "false")
        plan = report(again, "c5")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset(auto)
        assert "SelectedBucketsCount: 1 out of 16" in plan
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task per file
    try:
        assert again.filter("customer_id = 'c5'").rdd.getNumPartitions() == 1 < again.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(ValueError):
        copies.write_copy(rows, path, "customer_id")


def test_a_common_key_is_several_files(spark, make, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = make(*[sale(i, customer_id="hot" if i % 3 else f"c{i}") for i in range(20_000)])
        copy = copies.write_copy(rows.repartition(8), str(tmp_path / "copy"), "customer_id", 8)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = copy.filter("customer_id = 'hot'")
    assert hot.count() == sum(1 for i in range(20_000) if i % 3)
    names = [f.rsplit("_", 1)[1] for f in copy.inputFiles()]
    assert max(Counter(names).values()) > 1 and len(set(names)) == 8


def test_a_copy_of_nothing(spark, rows, tmp_path):
    copy = copies.write_copy(rows.limit(0), str(tmp_path / "copy"), "receipt_number", 4)
    assert copy.count() == 0 and copy.columns == SALES_COLUMNS
