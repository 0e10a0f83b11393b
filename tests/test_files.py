"""Round trips through files, table updates, ingest, views."""

import datetime as dt
import glob
import json
import zlib

import pytest
from sales_rows import sale
from pyspark.errors import StreamingQueryException

from tallygrove.operators import enrich
from tallygrove.plans import registry
from tallygrove.schema import DAY_PARTITION, MONTH_PARTITION, SALES_COLUMNS, SALES_SCHEMA
from tallygrove.sources import files, sinks
from tallygrove.streaming import ingest


@pytest.fixture(scope="module")
def rows(make):
    names = ['say "hi"', "a,b", " padded ", "back\\slash", "café", "plain"]
    return make(
        *[
            sale(i, product_name=names[i % len(names)], date=dt.datetime(2024, 1 + i % 3, 1 + i % 5, i % 24))
            for i in range(25)
        ]
    )


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


def one_csv(rows, tmp_path):
    return sinks.export_csv(rows, str(tmp_path / "src"), single_file=True)


def test_csv_round_trip(spark, rows, tmp_path):
    path = sinks.export_complete(rows, str(tmp_path / "out"))
    assert same(rows, files.read_csv(spark, path, SALES_SCHEMA))


def test_csv_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1), ('q"', 2)], "t string, n int")
    path = sinks.export_csv(df, str(tmp_path / "out"))
    assert same(df, files.read_csv(spark, path, "t string, n int", multi_line=True))


def test_csv_types_are_inferred(spark, rows, tmp_path):
    df = files.read_csv(spark, one_csv(rows, tmp_path))
    assert dict(df.dtypes)["age"] == "int" and dict(df.dtypes)["date"].startswith("timestamp")


def test_split_keeps_the_short_last_part(spark, rows, tmp_path):
    parts = sinks.split_csv(spark, one_csv(rows, tmp_path), str(tmp_path / "parts"), 10)
    found = sorted(glob.glob(f"{parts}/part-*.csv"))
    lines = [open(f, encoding="utf-8").read().splitlines() for f in found]
    assert sorted(len(p) - 1 for p in lines) == [5, 10, 10]
    assert all(p[0].startswith("date,transaction_id") for p in lines)
    whole = sinks.rebuild_csv(spark, parts, str(tmp_path / "whole"), single_file=True)
    assert len(glob.glob(f"{whole}/part-*.csv")) == 1
    assert same(rows, files.read_csv(spark, whole, SALES_SCHEMA))


def test_csv_to_parquet_and_back(spark, rows, tmp_path):
    parts = sinks.csv_to_parquet(spark, one_csv(rows, tmp_path), str(tmp_path / "pq"), 10, SALES_SCHEMA)
    assert len(glob.glob(f"{parts}/*.parquet")) == 3
    assert same(rows, files.read_parts(spark, [parts]))
    out = sinks.rebuild_parquet(spark, parts, str(tmp_path / "csv"))
    assert same(rows, files.read_csv(spark, out, SALES_SCHEMA))


@pytest.mark.parametrize("fmt, codec", [("csv", None), ("parquet", None), ("parquet", "gzip")])
def test_manifest(spark, rows, tmp_path, fmt, codec):
    sinks.replace_table(rows.filter("age is not null"), str(tmp_path / "c1"))
    sinks.replace_table(rows.limit(0), str(tmp_path / "c2"))
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"chunks": [{"file": "c1"}, {"file": "c2"}]}, indent=1))
    dst = sinks.rebuild_from_manifest(
        spark, str(manifest), str(tmp_path / "out"), fmt, sep="|", encoding="ISO-8859-1", codec=codec
    )
    if fmt == "parquet":
        assert glob.glob(f"{dst}/*.{ {None: 'zstd', 'gzip': 'gz'}[codec] }.parquet")
        assert same(rows, files.read_parts(spark, [dst]))
    else:
        text = "".join(open(f, encoding="latin-1").read() for f in glob.glob(f"{dst}/*.csv"))
        assert "date|transaction_id" in text and "café" in text


def test_manifest_rejects_other_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.rebuild_from_manifest(spark, "m.json", str(tmp_path), "xlsx")


def test_pack_is_zlib(spark, rows, tmp_path):
    packed = sinks.pack_csv(rows.coalesce(1), str(tmp_path / "packed"))
    (part,) = glob.glob(f"{packed}/*.deflate")
    text = zlib.decompress(open(part, "rb").read()).decode("utf-8")
    assert len(text.splitlines()) == 26
    assert same(rows, sinks.unpack_csv(spark, packed, SALES_SCHEMA))


def test_json(spark, tmp_path):
    (tmp_path / "cities.json").write_text('[{"name": "Arbor",\n "country": "Aland", "country_id": "C1"}]')
    row = files.read_json(spark, str(tmp_path / "cities.json")).first()
    assert (row["name"], row["country_id"]) == ("Arbor", "C1")


def test_append_is_safe_to_rerun(spark, rows, tmp_path):
    path = str(tmp_path / "fact")
    early, late = rows.filter("date < '2024-02-01'"), rows.filter("date >= '2024-02-01'")
    for name, chunk in (("a", early), ("b", late), ("b", late)):
        sinks.append_sales(chunk, path, name)
    assert same(rows, files.read_sales(spark, path, SALES_COLUMNS))
    sinks.append_sales(late.limit(0), path, "b")
    assert same(early, files.read_sales(spark, path, SALES_COLUMNS))
    sinks.write_partitioned(late, path + "2", MONTH_PARTITION)
    assert same(late, files.read_sales(spark, path + "2", SALES_COLUMNS))


@pytest.mark.parametrize("by", [DAY_PARTITION, MONTH_PARTITION])
def test_chunks_of_half_days_and_undated_rows_stay(spark, make, tmp_path, by):
    path = str(tmp_path / "fact")
    day = dt.datetime(1996, 7, 4)
    chunks = [make(*[sale(100 * k + i, date=day + dt.timedelta(hours=12 * k)) for i in range(10)], sale(990 + k, date=None)) for k in range(2)]
    for k in (0, 1, 1, 0):
        sinks.append_sales(chunks[k], path, f"half{k}", by)
    assert same(chunks[0].union(chunks[1]), files.read_sales(spark, path, SALES_COLUMNS))
    with pytest.raises(ValueError):
        sinks.append_sales(chunks[0], path, "../x")


def test_layout_without_adaptive_execution(spark, rows, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_partitioned(rows, str(tmp_path / "t"), DAY_PARTITION, bloom=sinks.LOOKUP_COLUMNS)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    days = glob.glob(f"{tmp_path}/t/{DAY_PARTITION}=*")
    assert len(days) == 15 and all(len(glob.glob(f"{d}/*.parquet")) == 1 for d in days)
    assert same(rows, files.read_sales(spark, str(tmp_path / "t"), SALES_COLUMNS))


TEXT = "t string, n int"


def odd_csv(folder, text):
    folder.mkdir()
    (folder / "a.csv").write_text(text)
    return str(folder)


def test_round_trips_keep_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "1"), ('q"\n\n', "2"), ("x,y", None)], "t string, n string")
    src = sinks.export_csv(df.coalesce(1), str(tmp_path / "src"))
    whole = sinks.rebuild_csv(spark, sinks.split_csv(spark, src, str(tmp_path / "p"), 1), str(tmp_path / "w"))
    assert same(df, files.read_csv(spark, whole, df.schema, multi_line=True))
    assert same(df, files.read_parts(spark, [sinks.csv_to_parquet(spark, src, str(tmp_path / "pq"), 1, df.schema)]))
    assert same(df, sinks.unpack_csv(spark, sinks.pack_csv(df, str(tmp_path / "z")), df.schema))


def test_reordered_headers_are_refused(spark, tmp_path):
    src = odd_csv(tmp_path / "src", "t,n\na,1\n")
    (tmp_path / "src/b.csv").write_text("n,t\n2,b\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, src, TEXT).collect()
    with pytest.raises(Exception, match="header"):
        sinks.rebuild_csv(spark, src, str(tmp_path / "w"))


@pytest.mark.parametrize("bad", ["a", "a,1,2", "a,one"])
def test_bad_rows_fail_or_are_kept(spark, tmp_path, bad):
    src = odd_csv(tmp_path / "src", f"t,n\nok,1\n{bad}\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.read_csv(spark, src, TEXT).collect()
    kept = files.read_csv(spark, src, TEXT, bad_rows="keep").collect()
    assert [r[files.BAD_ROW] for r in kept] == [None, bad]
    with pytest.raises(ValueError):
        files.read_csv(spark, src, TEXT, bad_rows="drop")


def test_ingest_refuses_bad_rows(spark, rows, tmp_path):
    src = one_csv(rows, tmp_path)
    (part,) = glob.glob(f"{src}/part-*.csv")
    good = open(part, encoding="utf-8").read().splitlines(keepends=True)
    with open(f"{src}/late.csv", "w", encoding="utf-8") as f:
        f.write(good[0] + good[1].replace("2024-", "notadate-", 1))
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        ingest.ingest_chunks(spark, src, str(tmp_path / "batch"))
    with pytest.raises(StreamingQueryException):
        ingest.ingest_new_chunks(spark, src, str(tmp_path / "fact"), str(tmp_path / "state"))


def test_replace_and_missing_table(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert files.read_sales(spark, path).count() == 0
    sinks.replace_table(rows, path)
    sinks.replace_table(rows.limit(3), path)
    assert files.read_sales(spark, path).count() == 3
    assert files.read_sales(spark, path, ["age", "city"]).columns == ["age", "city"]


def test_ingest_takes_only_new_chunks(spark, rows, tmp_path):
    chunks, dst, state = (str(tmp_path / n) for n in ("chunks", "fact", "state"))
    sinks.export_csv(rows.limit(10).coalesce(1), chunks)
    for _ in range(2):
        ingest.ingest_new_chunks(spark, chunks, dst, state)
        assert ingest.ingested(spark, dst).count() == 10
    rows.limit(4).coalesce(1).write.mode("append").options(**files.CSV_OPTIONS).csv(chunks)
    ingest.ingest_new_chunks(spark, chunks, dst, state)
    assert ingest.ingested(spark, dst).count() == 14
    ingest.ingest_chunks(spark, chunks, str(tmp_path / "batch"))
    assert same(ingest.ingested(spark, dst), ingest.ingested(spark, str(tmp_path / "batch")))
    assert glob.glob(f"{dst}/{MONTH_PARTITION}=*") and glob.glob(f"{tmp_path}/batch/{MONTH_PARTITION}=*")


def test_views(spark, rows, tmp_path):
    df = enrich.enrich_sales(rows)
    assert len(registry.VIEWS) == 7
    out = registry.run_view("Top Products by Revenue", df, str(tmp_path), dt.datetime(2024, 1, 2, 3, 4, 5))
    saved = files.read_csv(spark, f"{tmp_path}/Top_Products_by_Revenue_20240102_030405", out.schema)
    assert same(out, saved)
    names = registry.register_views(df)
    assert spark.sql(f"SELECT count(*) FROM {names[3]}").first()[0] > 0
    assert "high_value_vs_low_value_transactions" in names


def test_export_bundle(spark, rows, tmp_path):
    written = registry.export_bundle(enrich.enrich_sales(rows), str(tmp_path), single_file=True)
    assert len(written) == 6
    for path in written.values():
        assert len(glob.glob(f"{path}/part-*.csv")) == 1
