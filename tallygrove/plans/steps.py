"""Queries that show one operator each over the whole sales table.

Writers are shown as round trips: the table is written below the shared folder
and read back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions import bands, calendar
from tallygrove.functions.measures import mean, n_distinct, n_rows, total, total_int
from tallygrove.operators import clean, dimensions, enrich, filters, groups, order_stats, ranking
from tallygrove.plans import registry
from tallygrove.schema import AMOUNT, MONTH_PARTITION, ROW_ID, SALES_COLUMNS, SALES_SCHEMA
from tallygrove.session import shared_dir
from tallygrove.sources import files, sinks
from tallygrove.sources.star import report_table, sales_from_star, source_name, stored_sales
from tallygrove.streaming import ingest

Step = Callable[[SparkSession, str], DataFrame]

STEPS: dict[str, Step] = {}


def _step(fn: Step) -> Step:
    STEPS[fn.__name__.strip("_")] = fn
    return fn


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_sales(spark, sf_dir).select(SALES_COLUMNS)


def _once_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as they come out of the joins, for queries that pass over the whole table once and write it
    in another form: to lay it out by month, write and read it first would cost more than the joins."""
    return sales_from_star(spark, sf_dir).select(SALES_COLUMNS)


def _new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_written: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[str], object]) -> str:
    """A folder that several queries of one application read, written once for the source files as
    they are: new files, new copy."""
    key = (spark.sparkContext.applicationId, source_name(spark, sf_dir, kind))
    if key not in _written:
        path = _new_dir(spark, kind)
        write(path)
        _written[key] = path
    return _written[key]


def _source_csv(spark: SparkSession, sf_dir: str) -> str:
    """The sales table as CSV files."""
    return _once(spark, sf_dir, "csv", lambda path: sinks.export_complete(_once_over(spark, sf_dir), path))


def _source_chunks(spark: SparkSession, sf_dir: str) -> str:
    """The same as packed CSV files, for queries that make a table of them: a fifth of the size lies beside the table. A
    file is read by one task either way, as fields may have line breaks."""
    return _once(spark, sf_dir, "packed_csv", lambda path: sinks.export_complete(_once_over(spark, sf_dir), path, "gzip"))


def _figures(df: DataFrame) -> DataFrame:
    """What a filter keeps, per country."""
    return df.groupBy("country").agg(n_rows().alias("n"), total().alias("total"))


# --- scans and round trips -------------------------------------------------


@_step
def scan_sales(spark, sf_dir):
    return sales_from_star(spark, sf_dir)


@_step
def scan_stored(spark, sf_dir):
    path = sinks.replace_table(_sales(spark, sf_dir), _new_dir(spark, "table"))
    return files.read_sales(spark, path)


@_step
def sample_rows(spark, sf_dir):
    return ranking.sample(stored_sales(spark, sf_dir), 10)


@_step
def csv_export_scan(spark, sf_dir):
    return files.read_csv(spark, _source_csv(spark, sf_dir), SALES_SCHEMA)


@_step
def csv_split_rebuild(spark, sf_dir):
    parts = sinks.split_csv(spark, _source_csv(spark, sf_dir), _new_dir(spark, "parts"), 10_000)
    return files.read_csv(spark, sinks.rebuild_csv(spark, parts, _new_dir(spark, "rebuilt")), SALES_SCHEMA)


@_step
def csv_to_parquet_parts(spark, sf_dir):
    src = _source_csv(spark, sf_dir)
    dst = sinks.csv_to_parquet(spark, src, _new_dir(spark, "parts"), 10_000, SALES_SCHEMA)
    return files.read_parts(spark, [dst])


@_step
def parquet_rebuild_csv(spark, sf_dir):
    parts = sinks.replace_table(_once_over(spark, sf_dir), _new_dir(spark, "parts"))
    return files.read_csv(spark, sinks.rebuild_parquet(spark, parts, _new_dir(spark, "csv")), SALES_SCHEMA)


def _manifest(spark: SparkSession, sf_dir: str) -> str:
    """Two chunk folders and the manifest that lists them."""
    sales = _once_over(spark, sf_dir)  # each row is in one of them
    first = F.col("transaction_desc").eqNullSafe("Product Sale")

    def write(folder: str) -> None:
        sinks.replace_table(sales.filter(first), f"{folder}/part1")
        sinks.replace_table(sales.filter(~first), f"{folder}/part2")
        doc = "chunks array<struct<file string>>, compression string"
        row = ([("part1",), ("part2",)], "zstd")
        spark.createDataFrame([row], doc).coalesce(1).write.json(f"{folder}/manifest.json")

    return _once(spark, sf_dir, "chunks", write) + "/manifest.json"


@_step
def manifest_rebuild_csv(spark, sf_dir):
    dst = _new_dir(spark, "csv")
    sinks.rebuild_from_manifest(spark, _manifest(spark, sf_dir), dst, "csv", sep=";")
    return files.read_csv(spark, dst, SALES_SCHEMA, sep=";")


@_step
def manifest_rebuild_parquet(spark, sf_dir):
    dst = _new_dir(spark, "parquet")
    sinks.rebuild_from_manifest(spark, _manifest(spark, sf_dir), dst, "parquet")
    return files.read_parts(spark, [dst])


@_step
def csv_line_breaks(spark, sf_dir):
    """Names with line breaks, quotes and commas, split, rebuilt and packed."""
    sales = _once_over(spark, sf_dir)
    odd = F.concat(F.lit('"a,\n'), F.col("product_name"), F.lit('\n"'))
    rows = sales.select("transaction_id", "product_id", F.concat(odd, F.col("city")).alias("label"))
    src = sinks.export_csv(rows, _new_dir(spark, "odd"))
    whole = sinks.rebuild_csv(spark, sinks.split_csv(spark, src, _new_dir(spark, "parts"), 10_000), _new_dir(spark, "whole"))
    text = "transaction_id string, product_id string, label string"
    back = files.read_csv(spark, whole, text, multi_line=True)
    return sinks.unpack_csv(spark, sinks.pack_csv(back, _new_dir(spark, "packed")), text)


@_step
def json_cities(spark, sf_dir):
    """Cities as a JSON document, written and read back."""
    cities = _sales(spark, sf_dir).groupBy(F.col("city").alias("name"), "country", "country_id").count().drop("count")
    doc = cities.agg(F.to_json(F.sort_array(F.collect_list(F.struct("*")))).alias("value"))
    path = _new_dir(spark, "cities")
    doc.coalesce(1).write.text(path)
    return files.read_json(spark, path, "name string, country string, country_id string")


@_step
def type_map_json(spark, sf_dir):
    """The type map of ``clean_type_map`` read from a JSON file."""
    raw, types = _typed_input(spark, sf_dir)
    path = _new_dir(spark, "types")
    spark.createDataFrame([(json.dumps(types),)], "value string").coalesce(1).write.text(path)
    return clean.apply_json_map(raw, path)


@_step
def csv_pack_unpack(spark, sf_dir):
    packed = sinks.pack_csv(_once_over(spark, sf_dir), _new_dir(spark, "packed"))
    return sinks.unpack_csv(spark, packed, SALES_SCHEMA)


@_step
def append_rerun(spark, sf_dir):
    """Chunks that share days and hold undated sales, one of them loaded twice."""
    key = F.col("transaction_id").cast("bigint")
    sales = _sales(spark, sf_dir).withColumn("date", F.when(key % 97 != 0, F.col("date")))
    path, part = _new_dir(spark, "fact"), key % 3
    for chunk in (0, 1, 2, 1):
        rows = sales.filter(part.eqNullSafe(F.lit(chunk)))
        sinks.append_sales(rows, path, f"part{chunk}", MONTH_PARTITION)
    return files.read_sales(spark, path, SALES_COLUMNS)


@_step
def chunk_ingest(spark, sf_dir):
    chunks = _source_chunks(spark, sf_dir)
    return ingest.ingested(spark, ingest.ingest_chunks(spark, chunks, _new_dir(spark, "fact")))


@_step
def chunk_ingest_incremental(spark, sf_dir):
    """The stream form, run twice: the second run finds nothing new."""
    chunks = _source_chunks(spark, sf_dir)
    dst, state = _new_dir(spark, "fact"), _new_dir(spark, "state")
    for _ in range(2):
        ingest.ingest_new_chunks(spark, chunks, dst, state)
    return ingest.ingested(spark, dst)


@_step
def view_saved(spark, sf_dir):
    """A named view, saved as CSV and read back."""
    folder = _new_dir(spark, "views")
    registry.run_view("Hourly Sales Distribution", report_table(spark, sf_dir), folder)
    schema = "hour_of_day bigint, transaction_count bigint, total_revenue decimal(38,2), unique_customers bigint"
    return files.read_csv(spark, f"{folder}/*", schema)


@_step
def export_bundle_products(spark, sf_dir):
    """The export bundle; its product table read back."""
    written = registry.export_bundle(report_table(spark, sf_dir), _new_dir(spark, "bundle"))
    schema = (
        "product_name string, total_transactions bigint, total_revenue decimal(38,2), "
        "avg_transaction_value double, unique_customers bigint, countries_sold_in bigint, "
        "discounted_sales bigint, avg_discounted_price double"
    )
    return files.read_csv(spark, written["product_performance_analysis"], schema)


# --- typing, cleaning, dimensions, enrichment ------------------------------


@_step
def clean_ensure_columns(spark, sf_dir):
    return clean.ensure_columns(_sales(spark, sf_dir).drop("city", "income"))


def _dirty(sales: DataFrame) -> DataFrame:
    """Sales as text with unreadable values, chosen by the key."""
    text = clean.stage_as_strings(sales)
    key = F.col("transaction_id").cast("bigint")

    def spoil(name: str, every: int, bad: Column) -> Column:
        return F.when(key % every == 0, bad).otherwise(F.col(name))

    return text.withColumns(
        {
            "date": spoil("date", 13, F.lit("01/02/2024")),
            "age": F.when(key % 11 == 0, F.lit("n/a")).otherwise(
                spoil("age", 7, F.concat("age", F.lit(".7")))
            ),
            "units_sold": spoil("units_sold", 17, F.lit("")),
            "unit_price_sgd": spoil("unit_price_sgd", 19, F.lit("1.005")),
            AMOUNT: spoil(AMOUNT, 23, F.lit("99999999999.00")),
            "income": spoil("income", 29, F.lit("unknown")),
        }
    )


@_step
def clean_sanitize(spark, sf_dir):
    return clean.sanitize_sales(_dirty(_sales(spark, sf_dir)))


@_step
def clean_reset_amounts(spark, sf_dir):
    return clean.sanitize_sales(_dirty(_sales(spark, sf_dir)), reset_amounts=True)


def _typed_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    raw = _dirty(_sales(spark, sf_dir)).select(
        "transaction_id",
        F.col("date").alias("sale_date"),
        F.col("units_sold").alias("qty"),
        F.col("unit_price_sgd").alias("price"),
        F.col("product_name").alias("label"),
        F.col("country").alias("other"),
    )
    types = {
        "sale_date": "character 19",
        "qty": {"key": "qty", "value": "integer"},
        "price": "float",
        "label": "string",
        "other": "blob",
        "absent": "integer",
    }
    return raw, types


@_step
def clean_type_map(spark, sf_dir):
    return clean.apply_type_map(*_typed_input(spark, sf_dir))


@_step
def stage_strings(spark, sf_dir):
    return clean.stage_as_strings(_once_over(spark, sf_dir))


@_step
def staged_to_typed(spark, sf_dir):
    return clean.typed_from_staging(clean.stage_as_strings(_once_over(spark, sf_dir)))


@_step
def upsert_by_key(spark, sf_dir):
    """Country codes as parameter rows; those of a range of countries are replaced."""
    sales = _sales(spark, sf_dir)

    def codes(df: DataFrame, suffix: str) -> DataFrame:
        pairs = df.select(F.col("country_id").alias("code"), F.concat("country", F.lit(suffix)).alias("country"))
        return dimensions.country_code_parameters(pairs.distinct())

    recent = filters.between(sales, "country", "NATION_1", "NATION_2")
    return dimensions.upsert_by_key(codes(sales, ""), codes(recent, " (new)"), "key")


@_step
def cyclic_features(spark, sf_dir):
    """Features per weekday and month, to 12 decimals."""
    rows = enrich.cyclic_features(enrich.enrich_calendar(_sales(spark, sf_dir)))
    names = ["day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]
    return rows.groupBy(
        F.col("day_of_week").cast("bigint").alias("day_of_week"), F.col("month").cast("bigint").alias("month")
    ).agg(n_rows().alias("n"), *[(F.round(F.max(c), 12) + F.lit(0.0)).alias(c) for c in names])


@_step
def calendar_columns(spark, sf_dir):
    rows = enrich.enrich_calendar(_sales(spark, sf_dir))
    longs = ["hour", "day_of_week", "month", "year"]
    return rows.select(
        *ROW_ID, "day_of_week_text", "month_text", *[F.col(c).cast("bigint").alias(c) for c in longs]
    )


def _calendar_of(sales: DataFrame) -> DataFrame:
    """The calendar of the years sold in, and one more."""
    first, last = sales.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    return dimensions.discount_calendar(sales.sparkSession, first, last + 1)


@_step
def discount_calendar(spark, sf_dir):
    return _calendar_of(_sales(spark, sf_dir))


@_step
def discount_tagged(spark, sf_dir):
    """Sales in the periods of a calendar table (range join)."""
    sales = _sales(spark, sf_dir)
    tagged = enrich.enrich_discount(sales, _calendar_of(sales))
    return tagged.select("date", *ROW_ID, "discount_period", "discount_applied")


@_step
def geo_enriched(spark, sf_dir):
    """Country of each sale looked up by its city; two countries are unlisted."""
    sales = _sales(spark, sf_dir)
    cities = sales.filter(~F.col("country").isin("NATION_6", "NATION_18")).select(
        F.col("city").alias("name"), "country", "country_id"
    ).distinct()
    return dimensions.enrich_geo(sales, cities).select(*ROW_ID, "city", "country", "country_id")


@_step
def daily_gap_filled(spark, sf_dir):
    """Days from the first sale to the last; days without one appear with zeros."""
    rows = _sales(spark, sf_dir)
    daily = rows.groupBy(F.to_date("date").alias("sale_date")).agg(
        n_rows().alias("transactions"), total().alias("revenue")
    )
    return dimensions.fill_missing_days(daily)


@_step
def valid_dates(spark, sf_dir):
    """Date texts in good and bad formats."""
    key = F.col("transaction_id").cast("bigint")
    text = (
        F.when(key % 5 == 0, F.substring(F.col("date").cast("string"), 1, 10))
        .when(key % 7 == 0, "2024-13-01")
        .when(key % 11 == 0, "01/02/2024")
        .when(key % 13 == 0, "")
        .otherwise(F.col("date").cast("string"))
    )
    rows = _sales(spark, sf_dir).select("transaction_id", "product_id", text.alias("text"))
    return rows.withColumn("valid", calendar.valid_date("text"))


@_step
def age_bands(spark, sf_dir):
    per = _sales(spark, sf_dir).groupBy("age").agg(n_rows().alias("n"))
    return per.withColumns(
        {
            "band6": bands.age_band6(),
            "band3": bands.age_band3(),
            "band3n": bands.age_band3n(),
            "career": bands.career_segment(),
        }
    )


@_step
def income_segments(spark, sf_dir):
    per = _sales(spark, sf_dir).groupBy("income").agg(n_rows().alias("n"))
    label = bands.income_segment()
    order = bands.segment_order(label, bands.INCOME_SEGMENTS).cast("bigint")
    return per.withColumns({"segment": label, "place": order})


@_step
def hour_periods(spark, sf_dir):
    per = enrich.enrich_calendar(_sales(spark, sf_dir)).groupBy(
        F.col("hour").cast("bigint").alias("hour"), calendar.is_weekend("date").alias("weekend")
    )
    return per.agg(n_rows().alias("n")).withColumn("period", bands.time_period("hour"))


# --- filters ---------------------------------------------------------------


@_step
def filter_conjunction(spark, sf_dir):
    rows = filters.filter_sales(
        stored_sales(spark, sf_dir), "1996-02-10", "2000-03-05", None, None, 20, 60
    )
    return _figures(rows)


@_step
def filter_text(spark, sf_dir):
    return _figures(filters.eq(filters.eq(_sales(spark, sf_dir), "gender", "F"), "country", "NATION_6"))


@_step
def filter_date_range(spark, sf_dir):
    return _figures(filters.date_range(stored_sales(spark, sf_dir), "1997-05-20", "1997-06-10", True))


@_step
def filter_day(spark, sf_dir):
    return _figures(filters.on_day(stored_sales(spark, sf_dir), "1995-06-19"))


@_step
def filter_between(spark, sf_dir):
    return _figures(filters.between(_sales(spark, sf_dir), "income", 30000, 60000))


@_step
def filter_from_year(spark, sf_dir):
    return _figures(filters.from_year(stored_sales(spark, sf_dir), 1999))


@_step
def filter_known(spark, sf_dir):
    return _figures(filters.known(filters.known(_sales(spark, sf_dir), "age"), "income"))


@_step
def filter_in_list(spark, sf_dir):
    return _figures(filters.one_of(_sales(spark, sf_dir), "country", ["NATION_18", "NATION_6", "NATION_3"]))


@_step
def filter_discounted(spark, sf_dir):
    return _figures(filters.discounted(report_table(spark, sf_dir)))


@_step
def filter_thresholds(spark, sf_dir):
    rows = filters.above(filters.at_least(_sales(spark, sf_dir), AMOUNT, 20), "age", 30)
    return _figures(filters.above(rows, "income", 50000))


@_step
def filter_hour(spark, sf_dir):
    return _figures(filters.at_hour(_sales(spark, sf_dir), 12))


@_step
def filter_band(spark, sf_dir):
    return _figures(filters.in_band(_sales(spark, sf_dir), bands.AGE_BANDS_3N[1]))


# --- aggregates, windows, orderings ----------------------------------------


@_step
def overall_of_nothing(spark, sf_dir):
    """A global aggregate over no rows still has one row."""
    return groups.overall(
        filters.eq(_sales(spark, sf_dir), "country", "ATLANTIS"),
        n_rows().alias("n"),
        total().alias("total"),
        total_int("units_sold").alias("units"),
        mean().alias("average"),
        n_distinct("customer_id").alias("customers"),
    )


@_step
def medians(spark, sf_dir):
    """Exact medians of three columns over all rows."""
    sales = _sales(spark, sf_dir)
    found = order_stats.medians(sales, [AMOUNT, "income", "age"])
    out = sales.agg(n_rows().alias("n"))
    for name, column in (("median_amount", AMOUNT), ("median_income", "income"), ("median_age", "age")):
        out = out.withColumn(name, F.lit(found[column]).cast("double"))
    return out


@_step
def deciles(spark, sf_dir):
    """The decile of every sale by amount."""
    rows = _sales(spark, sf_dir).select(*ROW_ID, "customer_id", "receipt_number")
    return order_stats.with_decile(rows).select(*ROW_ID, F.col("value_decile").cast("bigint").alias("decile"))


@_step
def page_by_key(spark, sf_dir):
    """The third page, found from the last row of the second."""
    sales = stored_sales(spark, sf_dir)
    rows = [r.asDict() for r in ranking.page(sales, 2, 50).select(SALES_COLUMNS).collect()]
    if not rows:
        return sales.select(SALES_COLUMNS).limit(0)
    shown = ranking.copies_shown(rows, rows[-1])
    return ranking.page_after(sales, rows[-1], 50, shown).select(SALES_COLUMNS)


@_step
def rank_with_gaps(spark, sf_dir):
    """Products ranked by number of sales, where ties are common."""
    per = _sales(spark, sf_dir).groupBy("product_name").agg(n_distinct("city").alias("cities"))
    return ranking.with_rank(per, "cities", "place")


@_step
def top_per_country(spark, sf_dir):
    """The three best-selling products of each country."""
    per = _sales(spark, sf_dir).groupBy("country", "product_name").agg(total().alias("revenue"))
    return ranking.top_k_per_group(per, "country", 3, "revenue", "product_name")


@_step
def country_at_extremes(spark, sf_dir):
    """Countries with the highest and lowest average sale."""
    per = _sales(spark, sf_dir).groupBy("country").agg(mean().alias("average"))
    high = ranking.row_at_max(per, "average", "country").withColumn("side", F.lit("max"))
    low = ranking.row_at_min(per, "average", "country").withColumn("side", F.lit("min"))
    return high.unionByName(low)


@_step
def trimmed_cells(spark, sf_dir):
    """Cells of the five best products in the four best countries."""
    per = filters.sales_only(_sales(spark, sf_dir)).groupBy("product_name", "country").agg(
        total().alias("revenue")
    )
    return ranking.trim_axes(per, ("product_name", 5), ("country", 4), "revenue")
