"""What keeps tasks, shuffles and files in proportion when the tables grow."""

import datetime as dt
import glob
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sales_rows import sale

from tallygrove.plans import cells, steps, tables
from tallygrove.schema import SALES_COLUMNS, SALES_SCHEMA
from tallygrove.session import HASHED_GROUPS, hashed_groups, sized_tasks
from tallygrove.sources import copies, files, sinks, star
from tallygrove.streaming import ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_made_behind_the_shuffles(spark, sf_dir):
    text = plan(star._sales_columns(sinks.arranged_by(star._order_lines(spark, sf_dir), "sale_month"), "sale_month"))
    above, below = text.split("Sort [sale_month", 1)
    assert "Product Exchange" in above and "Product Exchange" not in below


def test_tasks_of_a_sorted_write_are_bounded(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    usual = spark.conf.get(name)
    for given, wanted in (("256m", f"{32 * 2**20}b"), ("1m", f"{2**20}b")):
        spark.conf.set(name, given)
        with sized_tasks(spark):
            assert spark.conf.get(name) == wanted
        assert spark.conf.get(name) == given
    spark.conf.set(name, usual)


@pytest.mark.parametrize("name, shuffled", [("versioned_publish", 0), ("upsert_months", 1), ("distinct_from_cells", 0)])
def test_stored_rows_are_not_laid_out_again(spark, sf_dir, monkeypatch, name, shuffled):
    """But for the rows that an upsert writes anew."""
    made, plain = [], sinks.arranged_by
    monkeypatch.setattr(sinks, "arranged_by", lambda df, *more: made.append((df, plain(df, *more))) or made[-1][1])
    star.stored_sales(spark, sf_dir)
    tables.TABLES[name](spark, sf_dir)
    assert len(made) > 1 and sum("Exchange" in plan(after) and "Exchange" not in plan(before) for before, after in made) == 0
    assert sum("Exchange" in plan(after) for _, after in made) == shuffled


def test_laid_out_rows_keep_their_files(spark, sf_dir, tmp_path):
    rows = star.stored_sales(spark, sf_dir)
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.replace(rows.select(SALES_COLUMNS), laid_out=True)
    assert len(table.read().inputFiles()) <= len(rows.inputFiles())
    assert table.read().select(SALES_COLUMNS).exceptAll(rows.select(SALES_COLUMNS)).count() == 0
    assert table.rows_per_day().agg(F.sum("n")).first()[0] == rows.count()


@pytest.mark.parametrize("name", [
    "stage_strings", "staged_to_typed", "csv_line_breaks", "csv_pack_unpack", "csv_to_parquet_parts", "chunk_ingest_incremental",
    "parquet_rebuild_csv", "manifest_rebuild_parquet",
])
def test_one_pass_does_not_store_the_sales_first(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(steps, "_written", {})
    for module in (steps, star):
        monkeypatch.setattr(module, "stored_sales", lambda *_: pytest.fail("stored first"))
    assert steps.STEPS[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["customer_from_copy", "receipt_from_copy"])
def test_copies_are_made_in_one_pass(spark, sf_dir, monkeypatch, name):
    for module in (steps, star):
        monkeypatch.setattr(module, "stored_sales", lambda *_: pytest.fail("stored first"))
    assert tables.TABLES[name](spark, sf_dir).count() > 0


def test_small_tasks_hash_many_sketches(spark):
    name, seen = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", []
    before = spark.conf.get(name)
    with hashed_groups(spark):
        seen.append(int(spark.conf.get(name)))
    assert seen == [HASHED_GROUPS] and spark.conf.get(name) == before


def test_merged_sketches_stay_close(spark):
    """24 hours of 40,000 customers each, spread over days, whose sketches are merged."""
    ids = spark.range(24 * 40_000).withColumn("hour", (F.col("id") % 24).cast("int"))
    day = F.expr("make_timestamp_ntz(2024, 1, 1 + CAST(id DIV 24 % 9 AS INT), hour, 0, 0)")
    text, money = F.col("id").cast("string"), F.lit("1.00").cast("decimal(10,2)")
    values = {"date": day, "transaction_desc": F.lit("Product Sale")}
    rows = ids.select(
        *[
            values.get(f.name, money if f.name.endswith("_sgd") else text if f.name.endswith(("_id", "_number")) else F.lit(None))
            .cast(f.dataType).alias(f.name)
            for f in SALES_SCHEMA
        ]
    )
    found = cells.hourly_distribution(cells.build(rows, [])).collect()
    assert len(found) == 24 and all(r.transaction_count == 40_000 for r in found)
    assert max(abs(r.unique_customers / 40_000 - 1) for r in found) < 0.0135


def test_csv_files_are_bounded(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 100, raising=False)
    rows = spark.range(1050).coalesce(1)

    def counts(path):
        return sorted(sum(1 for _ in open(f)) - 1 for f in glob.glob(f"{path}/*.csv"))

    assert counts(sinks.export_csv(rows, str(tmp_path / "many"))) == [50] + [100] * 10
    assert counts(sinks.export_csv(rows, str(tmp_path / "one"), single_file=True)) == [1050]
    assert files.read_csv(spark, str(tmp_path / "many"), "id bigint", multi_line=True).count() == 1050


def test_folders_are_deliveries(spark, make, tmp_path):
    """Also if a batch of the stream holds a part of a folder's files only."""
    inbox, dst, state = (str(tmp_path / n) for n in ("in box", "fact", "state"))
    first = [sale(i, date=dt.datetime(2024, 1 + i % 3, 2)) for i in range(10)]
    fixed = [sale(i, date=dt.datetime(2024, 5, 2), amt=9) for i in range(8)]
    other = [sale(100 + i, date=dt.datetime(2024, 2, 2)) for i in range(6)]
    os.makedirs(inbox)

    def send(rows, name, n=4):
        sinks.export_csv(make(*rows).repartition(n), str(tmp_path / "made" / name))
        os.rename(tmp_path / "made" / name, f"{inbox}/{name}")

    def run():
        ingest.ingest_deliveries(spark, inbox, dst, state, max_files=2)
        return Counter(map(tuple, files.read_sales(spark, dst, SALES_COLUMNS).collect()))

    send(first, "part_0.csv")
    send(other, "part_1.csv")
    assert run() == Counter(first + other)
    versions = sinks.sales_table(spark, dst).versions()
    send(other, "again.csv", 3)  # the same rows in other files
    assert run() == Counter(first + other) and sinks.sales_table(spark, dst).versions() == versions
    send(fixed, "part_0_v2.csv")
    assert run() == Counter(fixed + other)
    assert sorted(sinks.sales_table(spark, dst).head().ledger) == ["part_0", "part_1"]


def test_chunks_are_sent_in_several_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 500, raising=False)
    made = []
    monkeypatch.setattr(tables, "_new_dir", lambda s, name: made.append(steps._new_dir(s, name)) or made[-1])
    tables.TABLES["chunk_deliveries"](spark, sf_dir)
    sent = glob.glob(f"{made[0].removeprefix('file://')}/*/*.csv")
    assert len(sent) >= 14 and max(sum(1 for _ in open(f)) for f in sent) <= 501


def shuffle_files(spark):
    names = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "/shuffle_" in n and n.endswith(".data")}


def test_shuffle_files_go_with_their_write(spark, sf_dir, make, tmp_path):
    rows = make(*[sale(i, date=dt.datetime(2024, 1 + i % 3, 2)) for i in range(60)])
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    writes = {
        "csv": lambda path: sinks.export_csv(rows.repartition(4, "transaction_id"), path),
        "month folders": lambda path: sinks.write_partitioned(rows, path),
        "version": lambda path: table.replace(rows),
        "copy": lambda path: copies.write_copy(rows, path, "customer_id", 4),
    }
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(setting)
    for name, write in writes.items():
        before = shuffle_files(spark)
        write(str(tmp_path / name.replace(" ", "_")))
        wait_for(lambda: not shuffle_files(spark) - before, name)
        assert spark.conf.get(setting) == usual
    assert sorted(table.read().select(SALES_COLUMNS).collect()) == sorted(rows.collect())


def wait_for(done, what):
    """Executors remove files a moment later."""
    until = time.time() + 10
    while not done():
        assert time.time() < until, what
        time.sleep(0.1)


def test_a_batch_of_deliveries_leaves_no_shuffle_files(spark, make, tmp_path):
    inbox, dst, state = (str(tmp_path / n) for n in ("inbox", "fact", "state"))
    rows = [sale(i, date=dt.datetime(2024, 1 + i % 3, 2)) for i in range(10)]
    sinks.export_csv(make(*rows[:6]), f"{inbox}/chunk_0.csv")
    sinks.export_csv(make(*rows[6:]), f"{inbox}/chunk_1.csv", compression="gzip")
    assert glob.glob(f"{inbox}/chunk_0.csv/*.csv") and glob.glob(f"{inbox}/chunk_1.csv/*.csv.gz")
    before = shuffle_files(spark)
    ingest.ingest_deliveries(spark, inbox, dst, state)
    wait_for(lambda: not shuffle_files(spark) - before, "batch")
    sinks.export_csv(make(*rows[:6]), f"{inbox}/again.csv", compression="gzip")
    version = sinks.sales_table(spark, dst).head().number
    ingest.ingest_deliveries(spark, inbox, dst, state)
    assert sinks.sales_table(spark, dst).head().number == version
    assert Counter(map(tuple, files.read_sales(spark, dst, SALES_COLUMNS).collect())) == Counter(rows)


def test_chunks_that_are_not_corrected_are_packed(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(tables, "_new_dir", lambda s, name: made.append(steps._new_dir(s, name)) or made[-1])
    rows = tables.TABLES["chunk_deliveries"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    inbox = made[0].removeprefix("file://")
    packed = {name for name in os.listdir(inbox) if glob.glob(f"{inbox}/{name}/*.csv.gz")}
    plain = {name for name in os.listdir(inbox) if glob.glob(f"{inbox}/{name}/*.csv")}
    assert plain == {"chunk_1.csv", "chunk_1_v2.csv"} and packed == set(os.listdir(inbox)) - plain


@pytest.mark.parametrize("name", ["chunk_ingest_incremental", "chunk_ingest"])
def test_chunks_to_ingest_are_packed(spark, sf_dir, monkeypatch, name):
    made = []
    monkeypatch.setattr(steps, "_written", {})
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 500)
    monkeypatch.setattr(steps, "_new_dir", lambda s, kind, plain=steps._new_dir: made.append(plain(s, kind)) or made[-1])
    assert steps.STEPS[name](spark, sf_dir).exceptAll(star.sales_from_star(spark, sf_dir).select(SALES_COLUMNS)).count() == 0
    source = made[0].removeprefix("file://")
    assert len(glob.glob(f"{source}/*.csv.gz")) >= 12 and not glob.glob(f"{source}/*.csv")


def test_an_upsert_leaves_no_shuffle_files(spark, make, tmp_path):
    """Neither those of the keys, which are more than those of the rows it writes."""
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    rows = [sale(i, date=dt.datetime(2024, 1 + i % 3, 2)) for i in range(30)]
    key, usual = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        table.replace(make(*rows))
        before = shuffle_files(spark)
        table.upsert(make(sale(3, date=dt.datetime(2024, 5, 2)), sale(99)), ["transaction_id"])
        wait_for(lambda: not shuffle_files(spark) - before, "upsert")
    finally:
        spark.conf.set(key, usual)
    found = Counter(map(tuple, table.read().select(SALES_COLUMNS).collect()))
    assert found == Counter([r for r in rows if r[1] != "3"] + [sale(3, date=dt.datetime(2024, 5, 2)), sale(99)])


def test_sources_kept_for_several_queries_are_apart(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(steps, "_written", {})
    sources = [source(spark, sf_dir) for source in (steps._source_csv, steps._source_chunks, steps._manifest)]
    assert len({s.removesuffix("/manifest.json") for s in sources}) == 3
