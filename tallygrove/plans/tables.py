"""Queries that show how the stored table is kept (versions, corrections, deliveries, pages) and
how it is joined: with time intervals, and with a long list whose keys are skewed; and reports from
aggregates kept beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.measures import n_rows, total
from tallygrove.operators import enrich, intervals, lookup, ranking
from tallygrove.plans import api, cells, exports, summary
from tallygrove.plans.steps import _calendar_of, _new_dir, _once_over, _sales
from tallygrove.schema import AMOUNT, MONTH_PARTITION, ROW_ID, SALES_COLUMNS
from tallygrove.sources import copies, files, sinks
from tallygrove.sources.star import report_table, stored_sales
from tallygrove.sources.storage import Folder
from tallygrove.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

TABLES: dict[str, Query] = {}


def _table(fn: Query) -> Query:
    TABLES[fn.__name__.strip("_")] = fn
    return fn


def _key():
    return F.col("transaction_id").cast("bigint")


def _state(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy("country").agg(n_rows().alias("n"), total().alias("total")).withColumn("state", F.lit(label))


@_table
def versioned_publish(spark, sf_dir):
    """What readers see: the first version, the same while the next one is being written and when that
    is broken off, the next one once it is published, and the first one again by its number."""
    sales = _sales(spark, sf_dir)  # stored by month, so not laid out again
    early = sales.filter(F.year("date") < 1998)
    table = sinks.sales_table(spark, _new_dir(spark, "versions"))
    first = table.replace(early, laid_out=True)
    opened = table.read()
    table.write_run(sales.withColumn("sale_chunk", F.lit("base")), laid_out=True)  # written, never published
    broken_off = table.read()
    table.replace(sales, laid_out=True)
    states = [(opened, "opened before"), (broken_off, "broken off"), (table.read(), "published"), (table.read(first), "by number")]
    out = _state(*states[0])
    for rows, label in states[1:]:
        out = out.unionByName(_state(rows, label))
    return out


@_table
def upsert_months(spark, sf_dir):
    """Sales of two months corrected, one of them moved to another month, and new sales added; only
    the months concerned are written."""
    sales = _sales(spark, sf_dir)
    table = sinks.sales_table(spark, _new_dir(spark, "upsert"))
    table.replace(sales, laid_out=True)
    month = F.date_format("date", "yyyy-MM")
    fixed = sales.filter(month.isin("1996-02", "1997-07") & (_key() % 10 == 0))
    fixed = fixed.withColumn("units_sold", F.col("units_sold") + 100).withColumn(
        "date", F.when(month == "1996-02", F.col("date")).otherwise(F.expr("date + INTERVAL 2 MONTHS"))
    )
    extra = sales.filter(month == "1999-03").withColumn("transaction_id", F.concat(F.lit("9"), "transaction_id"))
    table.upsert(fixed.unionByName(extra), ROW_ID)
    return table.read().select(SALES_COLUMNS)


@_table
def page_indexed(spark, sf_dir):
    """A deep page found by the counts stored with the table."""
    table = sinks.sales_table(spark, _new_dir(spark, "pages"))
    table.replace(_sales(spark, sf_dir), laid_out=True)
    return ranking.page(table.read(), 41, 25, table.rows_per_day()).select(SALES_COLUMNS)


@_table
def chunk_deliveries(spark, sf_dir):
    """Four chunks, each a folder of files, one with wrong amounts; then that one corrected, one sent again under a new
    name and one sent again unchanged. The amounts come out right and no row twice. The chunk that is corrected comes as plain
    CSV, the others as packed CSV, which is a fifth as large or less."""
    sales = _sales(spark, sf_dir)
    inbox, dst, state = (_new_dir(spark, n) for n in ("inbox", "fact", "state"))
    part = F.pmod(_key(), F.lit(4))

    def send(rows: DataFrame, name: str, compression: str = "gzip") -> None:
        home, made = f"{inbox}-sent", uuid.uuid4().hex
        sinks.export_csv(rows, f"{home}/{made}", compression=compression)
        Folder(spark, home).move(made, f"{inbox}/{name}")

    for k in range(4):
        rows = sales.filter(part == k)
        if k == 1:
            send(rows.withColumn(AMOUNT, F.lit("1.00").cast("decimal(10,2)")), f"chunk_{k}.csv", "none")
        else:
            send(rows, f"chunk_{k}.csv")
    ingest.ingest_deliveries(spark, inbox, dst, state)
    send(sales.filter(part == 1), "chunk_1_v2.csv", "none")
    send(sales.filter(part == 2), "again.csv")
    send(sales.filter(part == 3), "chunk_3_v2.csv")
    ingest.ingest_deliveries(spark, inbox, dst, state)
    return files.read_sales(spark, dst, SALES_COLUMNS)


def _hours(spark: SparkSession, sales: DataFrame) -> DataFrame:
    """Happy hours of each discount period, which overlap: its first day until noon (1), each of its
    days from 10 to 15 o'clock (2), and the whole of it (3)."""
    days = _calendar_of(sales)
    begin, stop = F.col("start_d").cast("timestamp_ntz"), F.date_add("end_d", 1).cast("timestamp_ntz")
    name = F.col("discount_period")

    def span(prio: int, suffix: str, start, end):
        return days.select(
            (F.col("prio") + 10 * prio).alias("prio"), F.concat(name, F.lit(suffix)).alias("discount_period"), start.alias("start_t"), end.alias("end_t")
        )

    daily = days.withColumn("start_d", F.explode(F.sequence("start_d", "end_d")))
    rush = daily.select(
        (F.col("prio") + 20).alias("prio"), F.concat(name, F.lit(" rush")).alias("discount_period"),
        (begin + F.expr("INTERVAL 10 HOURS")).alias("start_t"), (begin + F.expr("INTERVAL 15 HOURS")).alias("end_t"),
    )
    early = span(1, " early", begin, begin + F.expr("INTERVAL 12 HOURS"))
    return early.unionByName(rush).unionByName(span(3, "", begin, stop))


@_table
def interval_tagged(spark, sf_dir):
    """Each sale with the first of the overlapping hour-wise periods that holds it."""
    sales = _sales(spark, sf_dir)
    tagged = enrich.enrich_periods(sales, _hours(spark, sales))
    return tagged.select("date", *ROW_ID, "discount_period", "discount_applied")


@_table
def interval_totals(spark, sf_dir):
    """Sales per period, a sale counted in each period that holds it; by the join for many intervals."""
    sales = _sales(spark, sf_dir)
    rows = intervals.tag_all(sales, _hours(spark, sales), closed=False, broadcast_rows=0)
    return rows.groupBy("discount_period").agg(n_rows().alias("n"), total().alias("total"))


@_table
def lookup_hot_city(spark, sf_dir):
    """The city lookup by the join for long lists; a third of the sales is in one city, some in none."""
    sales = _sales(spark, sf_dir)
    city = F.when(_key() % 3 == 0, "NATION_1-0").when(_key() % 53 != 1, F.col("city"))
    cities = sales.filter(~F.col("country").isin("NATION_6", "NATION_18")).groupBy("city").agg(F.min("country_id").alias("listed_id"))
    rows = sales.select(*ROW_ID, city.alias("city"))
    return lookup.lookup_join(rows, cities, "city", broadcast_rows=0).select(*ROW_ID, "city", "listed_id")


def _kept_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells of the sales, appended in three chunks of which one is delivered twice. A chunk is a third of the
    months, so it is read without a look at the others, and laid out already."""
    sales, table = stored_sales(spark, sf_dir), sinks.sales_table(spark, _new_dir(spark, "cells"))
    kept = cells.daily_cells(table)
    third = F.coalesce(F.month(MONTH_PARTITION), F.lit(0)) % 3
    for chunk in (0, 1, 2, 1):
        table.append(sales.filter(third == chunk).select(SALES_COLUMNS), f"part{chunk}", laid_out=True)
        kept.refresh()
    return kept.read()


def _beside(estimated: DataFrame, exact: DataFrame, keys: list[str], distinct: list[str]) -> DataFrame:
    """Rows of a report from cells, and whether each distinct count is within 2 % of the exact one."""
    right = exact.select(*[F.col(c).alias(f"_{c}") for c in keys + distinct])
    same, close = F.lit(True), F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    for c in distinct:
        close = close & (F.abs(F.col(c) - F.col(f"_{c}")) * 50 <= F.col(f"_{c}"))
    return estimated.join(right, same).withColumn("close", close)


@_table
def distinct_from_cells(spark, sf_dir):
    """Customers per hour and per year from stored sketches, against exact counts."""
    kept, df = _kept_cells(spark, sf_dir), report_table(spark, sf_dir)
    hours = _beside(cells.hourly_distribution(kept), api.hourly_distribution(df), ["hour_of_day"], ["unique_customers"])
    years = _beside(cells.yearly_customers(kept), summary.yearly_customers(df), ["year"], ["unique_customers"])
    hours = hours.select(F.lit("hour").alias("grain"), F.col("hour_of_day").alias("value"), "total_revenue", "close")
    return hours.unionByName(years.select(F.lit("year").alias("grain"), F.col("year").cast("bigint").alias("value"), "total_revenue", "close"))


# Of each report of the bundle: its exact form, keys, count, revenue, average and distinct counts.
_BUNDLE = {
    "sales_summary_by_country": (exports.sales_by_country, ["country"], "total_transactions", "total_revenue", "avg_transaction_value", ["unique_customers", "unique_products"]),
    "hourly_sales_analysis": (exports.hourly_sales, ["hour"], "total_transactions", "total_revenue", "avg_transaction_value", ["unique_customers", "unique_receipts"]),
    "discount_periods_analysis": (exports.discount_periods, ["discount_period"], "transactions", "revenue", "avg_transaction", ["customers"]),
    "regular_vs_discount_comparison": (exports.regular_vs_discount, ["price_type"], "transactions", "revenue", "transaction_percentage", ["customers"]),
    "age_group_analysis": (exports.age_by_country, ["country", "age_group"], "total_transactions", "total_revenue", "avg_age_in_group", ["unique_customers"]),
    "product_performance_analysis": (exports.product_performance, ["product_name"], "discounted_sales", "total_revenue", "avg_discounted_price", ["unique_customers", "countries_sold_in"]),
}


@_table
def bundle_from_cells(spark, sf_dir):
    """All six analyses of the export bundle from daily cells, against the exact ones."""
    kept, df, out = _kept_cells(spark, sf_dir), report_table(spark, sf_dir), None
    for name, (exact, keys, n, revenue, average, distinct) in _BUNDLE.items():
        rows = _beside(cells.BUNDLE[name](kept), exact(df), keys, distinct).select(
            F.lit(name).alias("report"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"),
            F.col(n).alias("n"), F.col(revenue).alias("revenue"), F.col(average).alias("average"), "close",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@_table
def customer_from_copy(spark, sf_dir):
    """A customer's totals from the copy for look-ups by customer."""
    copy = copies.write_copy(_once_over(spark, sf_dir), _new_dir(spark, "by-customer"), "customer_id")
    return api.customer_totals(copy, "7")


@_table
def receipt_from_copy(spark, sf_dir):
    """The items of a receipt from the copy for look-ups by receipt, opened anew."""
    path = _new_dir(spark, "by-receipt")
    copies.write_copy(_once_over(spark, sf_dir), path, "receipt_number")
    return api.receipt_items(copies.open_copy(spark, path), "20")
