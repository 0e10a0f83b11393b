"""Tables kept in versions: what readers see, what is written, what is deleted."""

import datetime as dt
import glob
import json
import os
from collections import Counter

import pytest
from sales_rows import sale

from tallygrove.operators import ranking
from tallygrove.schema import DAY_PARTITION, MONTH_PARTITION, SALES_COLUMNS, SALES_SCHEMA
from tallygrove.sources import files, sinks
from tallygrove.sources.versions import VersionConflict, VersionedTable
from tallygrove.streaming import ingest

KEYS = ["transaction_id", "product_id"]


@pytest.fixture()
def rows(make):
    """Six months of ten sales, and two without a date."""
    dated = [sale(100 * m + i, date=dt.datetime(2024, m, 1 + 2 * i, i), amt=f"{m}.{i}0") for m in range(1, 7) for i in range(10)]
    return make(*dated, sale(900, date=None), sale(901, date=None))


def same(a, b):
    return Counter(map(tuple, a.select(SALES_COLUMNS).collect())) == Counter(map(tuple, b.select(SALES_COLUMNS).collect()))


def data_files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_readers_keep_their_version(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    table = sinks.sales_table(spark, path)
    assert table.read().count() == 0 and table.head().number == 0
    assert table.replace(rows.limit(20)) == 1
    opened = table.read()
    table.write_run(rows.selectExpr("*", "'base' AS sale_chunk"))  # a write that was broken off
    assert table.read().count() == opened.count() == 20
    assert table.replace(rows) == 2
    assert opened.count() == 20 and same(table.read(), rows) and table.read(1).count() == 20
    assert [(r["version"], r["action"], r["runs"]) for r in table.history().collect()] == [(2, "replace", 1), (1, "replace", 1)]
    assert MONTH_PARTITION in table.read().columns and same(files.read_sales(spark, path), rows)


def test_a_half_written_pointer_is_not_seen(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(rows, path)
    (tmp_path / "t/_log/.000000000002.json-x").write_text('{"numb')
    assert same(files.read_sales(spark, path), rows)


def test_only_one_of_two_writers_publishes(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.replace(rows)
    head = table.head()
    table._publish(head, head, "first")
    with pytest.raises(VersionConflict):
        table._publish(head, head, "second")
    assert table.versions() == [1, 2]


def test_an_append_is_applied_to_what_others_published(spark, rows, tmp_path, monkeypatch):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    other = sinks.sales_table(spark, str(tmp_path / "t"))
    heads = [table.head()]  # read before the other's version
    other.append(rows.filter("date < '2024-03-01'"), "a")
    real = VersionedTable.head
    monkeypatch.setattr(VersionedTable, "head", lambda self: heads.pop() if heads else real(self))
    assert table.append(rows.filter("date >= '2024-03-01' OR date IS NULL"), "b") == 2
    assert same(table.read(), rows)


def test_chunks_replace_their_own_rows(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    early, late = rows.filter("month(date) < 4"), rows.filter("month(date) >= 4 OR date IS NULL")
    table.append(early, "a")
    table.append(late, "b")
    before = data_files(table.path)
    table.append(early.limit(3), "a")
    assert table.read().count() == 3 + late.count()
    assert before.items() <= data_files(table.path).items()  # no file was touched
    table.append(early.limit(0), "b")
    assert same(table.read(), early.limit(3)) and same(table.read(2), rows)
    with pytest.raises(ValueError):
        table.append(rows, "a/b")
    with pytest.raises(ValueError):
        sinks.sales_table(spark, table.path, DAY_PARTITION).append(rows, "c")


def test_upsert_writes_only_the_folders_concerned(spark, make, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.append(rows.filter("month(date) < 4"), "a")
    table.append(rows.filter("month(date) >= 4 OR date IS NULL"), "b")
    before = data_files(table.path)
    new = make(
        sale(203, date=dt.datetime(2024, 2, 7, 3), amt=77),  # as it was, with another amount
        sale(504, date=dt.datetime(2024, 6, 2), amt=78),  # moves from May to June
        sale(900, date=None, amt=79),
        sale(5000, date=dt.datetime(2024, 12, 24), amt=80),
        sale(5001, date=None, amt=81), sale(5001, date=None, amt=82),  # of two the last by all columns counts
    )
    table.upsert(new, KEYS)
    want = {r["transaction_id"]: tuple(r) for r in rows.collect()} | {r["transaction_id"]: tuple(r) for r in new.collect()}
    got = table.read().select(SALES_COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(want.values())
    after = data_files(table.path)
    assert before.items() <= after.items()
    written = Counter(f.split("/data/table_run=")[1].split("/", 1)[1].rsplit("/", 1)[0] for f in after if f not in before)
    a, b, added = ("sale_chunk=" + c for c in ("a", "b", "added"))
    none = "__HIVE_DEFAULT_PARTITION__"
    assert set(written) == {
        f"{a}/sale_month=2024-02-01", f"{b}/sale_month=2024-05-01", f"{b}/sale_month=2024-06-01", f"{b}/sale_month={none}",
        f"{added}/sale_month=2024-12-01", f"{added}/sale_month={none}",
    }
    live = {f"{run}/{f}" for run, folders in table.head().runs.items() for f in folders}
    assert len(live) == 6 + 1 + 3  # six months and the undated sales; June has two runs, and two folders are new
    assert {tuple(r) for r in table.rows_per_day().collect()} == {
        tuple(r) for r in table.read().selectExpr("to_date(date) AS day").groupBy("day").count().collect()
    }
    table.append(rows.limit(0), "b")  # the corrected rows of a chunk go with it
    assert {r["transaction_id"] for r in table.read().collect()} == {str(100 * m + i) for m in (1, 2, 3) for i in range(10)} | {"5000", "5001"}


def test_upsert_of_nothing_and_into_nothing(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.upsert(rows, KEYS)
    assert same(table.read(), rows)
    before = data_files(table.path)
    table.upsert(rows.limit(0), KEYS)
    assert same(table.read(), rows) and data_files(table.path) == before


def test_vacuum(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.append(rows.filter("month(date) < 4"), "a")
    table.append(rows.filter("month(date) >= 4 OR date IS NULL"), "b")
    table.write_run(rows.selectExpr("*", "'base' AS sale_chunk"))
    table.upsert(rows.filter("transaction_id = '203'").withColumn("age", rows["age"] + 1), KEYS)
    latest = table.read().collect()
    assert table.vacuum(keep=2) == []  # everything is young
    assert len(table.versions()) == 2
    gone = table.vacuum(keep=1, hours=-1)
    assert len(gone) == 2  # the run that was broken off, and one month of chunk a
    assert Counter(map(tuple, table.read().collect())) == Counter(map(tuple, latest)) and table.versions() == [3]


def test_tables_without_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, None)], "n int, t string")
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(df)
    table.replace(df.selectExpr("n", "t", "1.5D AS x"))
    assert table.read().columns == ["n", "t", "x"] and table.read(1).columns == ["n", "t"]
    table.upsert(spark.createDataFrame([(None, "z", 2.5)], table.read().schema), ["n"])
    assert Counter(map(tuple, table.read().collect())) == Counter([(1, "a", 1.5), (None, "z", 2.5)])
    table.replace(table.read().limit(0))
    assert table.read().count() == 0 and table.read().columns == ["n", "t", "x"]


def test_pages_from_stored_counts(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.append(rows, "a")
    table.append(rows.limit(0), "b")
    days = table.rows_per_day()
    for number, size in ((1, 7), (4, 7), (9, 7), (3, 30), (99, 10)):
        want = ranking.page(rows, number, size).collect()
        assert [tuple(r) for r in ranking.page(table.read(), number, size, days).select(SALES_COLUMNS).collect()] == [tuple(r) for r in want]


def test_a_deep_page_runs_no_job_over_rows(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.replace(rows)
    read, days = table.read(), table.rows_per_day()
    plan = ranking.page(read, 5, 10, days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_month" in plan
    assert days.inputFiles() and all("/_days/" in f for f in days.inputFiles())


def csv(folder, name, rows, header=True):
    os.makedirs(folder, exist_ok=True)
    lines = [",".join(SALES_COLUMNS)] if header else []
    lines += [",".join("" if v is None else v.isoformat(" ") if isinstance(v, dt.datetime) else str(v) for v in r) for r in rows]
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_deliveries(spark, tmp_path):
    inbox, dst, state = (str(tmp_path / n) for n in ("inbox", "fact", "state"))
    chunks = [[sale(100 * k + i, date=dt.datetime(2024, 1 + (k + i) % 3, 2)) for i in range(5)] for k in range(3)]

    def run():
        ingest.ingest_deliveries(spark, inbox, dst, state)
        return Counter(map(tuple, files.read_sales(spark, dst, SALES_COLUMNS).collect()))

    def total(*lists):
        return Counter(r for rows in lists for r in rows)

    csv(inbox, "part_0.csv", chunks[0])
    csv(inbox, "part_1.csv", chunks[1])
    assert run() == total(chunks[0], chunks[1])
    assert run() == total(chunks[0], chunks[1])
    csv(inbox, "part_0_v2.csv", chunks[0][::-1])  # the same rows in another order
    csv(inbox, "copy.csv", chunks[1])  # sent again under another name
    versions = sinks.sales_table(spark, dst).versions()
    assert run() == total(chunks[0], chunks[1]) and sinks.sales_table(spark, dst).versions() == versions
    fixed = [sale(100 + i, date=dt.datetime(2024, 7, 1), amt=9) for i in range(4)]
    csv(inbox, "part_1-rev3.csv", fixed)
    csv(inbox, "part_2.csv", chunks[2])
    csv(inbox, "empty.csv", [])
    assert run() == total(chunks[0], fixed, chunks[2])
    ledger = sinks.sales_table(spark, dst).head().ledger
    assert sorted(ledger) == ["part_0", "part_1", "part_2"] and ledger["part_1"]["file"].endswith("part_1-rev3.csv")


def test_a_batch_is_published_once(spark, rows, tmp_path):
    """A crash behind the publishing and before the stream's own note of it."""
    dst = str(tmp_path / "fact")
    batch = rows.selectExpr("*", "'file:/x/part_0.csv' AS _source_file", "TIMESTAMP '2024-01-01' AS _source_time")
    assert ingest.put_batch(batch, dst, ingest.chunk_of, ("s", 4)) == ["part_0"]
    more = batch.withColumn("age", batch["age"] + 1)
    assert ingest.put_batch(more, dst, ingest.chunk_of, ("s", 4)) == []
    assert ingest.put_batch(more, dst, ingest.chunk_of, ("s", 5)) == ["part_0"]
    assert files.read_sales(spark, dst).count() == rows.count()


def test_chunk_names():
    names = {"a/sales_0007.csv": "sales_0007", "sales_0007_v2.csv": "sales_0007", "s-rev12.csv.gz": "s", "2024-01.csv": "c2024-01", "x%20y.r2.csv": "cx_y"}
    assert {n: ingest.chunk_of(n) for n in names} == names


def test_log_is_small_text(spark, rows, tmp_path):
    table = sinks.sales_table(spark, str(tmp_path / "t"))
    table.replace(rows)
    (log,) = glob.glob(f"{tmp_path}/t/_log/*.json")
    entry = json.load(open(log))
    assert entry["number"] == 1 and len(entry["schema"]["fields"]) == len(SALES_SCHEMA) and len(list(entry["runs"].values())[0]) == 7
