"""Reports from daily cells: sums and mergeable sketches per day and dimension.

One scan gives every row to a cell of each kind (its hour, its country, ...). Cells hold what can be
added up, and HLL sketches of customers and of one more id; a report adds them up for
its groups. Sums, counts and averages are exact; distinct counts are estimates with a standard error of
0.41 % once merged (2 ** 16 registers), exact but for some parts in a million below some 8,000. An estimate 2 % off is one in a
million then; with 2 ** 14 registers it was one in seventy. A sketch of few ids is a list of them, so most
cells of a day cost 4 bytes per id and none more than 64 KB.

Cells are kept beside the sales table and made for new files only, so a report over years of sales
reads some hundred rows per day, and a chunk that arrives costs a scan of that chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import bands
from tallygrove.functions.measures import n_if, n_rows, ratio, total, total_if
from tallygrove.operators import enrich, groups, ranking
from tallygrove.plans.exports import price_type
from tallygrove.schema import AMOUNT, SALE, TOTAL_TYPE
from tallygrove.sources.sinks import export_all
from tallygrove.sources.summaries import Summary
from tallygrove.sources.versions import VersionedTable

PRECISION = 16

SCHEMA = (
    "day date, kind string, k1 string, k2 string, n bigint, revenue decimal(38,2), n_discounted bigint, "
    "discounted_revenue decimal(38,2), sum_age bigint, customers binary, others binary"
)


def _cells_of() -> Column:
    """The cells of a row: kind, its key or two, and the id that is counted beside the customers."""
    none = F.lit(None).cast("string")
    sale = F.col("transaction_desc") == SALE
    hour = F.hour("date").cast("string")

    def cell(kind: str, k1: Column, k2: Column, other: Column, held: Column) -> Column:
        return F.when(held, F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), k2.alias("k2"), other.alias("other")))

    return F.filter(
        F.array(
            cell("hour_all", hour, none, none, F.lit(True)),
            cell("hour", hour, none, F.col("receipt_number"), sale),
            cell("country", F.col("country"), none, F.col("product_name"), sale),
            cell("period", F.col("discount_period"), none, none, sale & F.col("discount_applied")),
            cell("price", price_type("Discounted", "Regular Price"), none, none, sale),
            cell("age", F.col("country"), bands.age_band3(), none, sale & F.col("age").isNotNull()),
            cell("product", F.col("product_name"), none, F.col("country"), sale),
        ),
        lambda c: c.isNotNull(),
    )


def build(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of sales rows, per ``keys``."""
    df = enrich.enrich_sales(rows)
    dealt = df.select(
        *keys, F.to_date("date").alias("day"), F.inline(_cells_of()), AMOUNT, "discount_applied", "age", "customer_id"
    )
    return dealt.groupBy(*keys, "day", "kind", "k1", "k2").agg(
        n_rows().alias("n"),
        total().alias("revenue"),
        n_if("discount_applied").alias("n_discounted"),
        total_if("discount_applied").alias("discounted_revenue"),
        F.sum(F.col("age").cast("bigint")).alias("sum_age"),
        F.hll_sketch_agg("customer_id", PRECISION).alias("customers"),
        F.hll_sketch_agg("other", PRECISION).alias("others"),
    )


def daily_cells(table: VersionedTable) -> Summary:
    """The cells kept beside a sales table."""
    return Summary(table, "cells", build, SCHEMA)


def _of(cells: DataFrame, kind: str) -> DataFrame:
    return cells.filter(F.col("kind") == kind)


def _n() -> Column:
    return F.sum("n").cast("bigint")


def _revenue(c: str = "revenue") -> Column:
    return F.sum(c).cast(TOTAL_TYPE)


def _mean(value: str = "revenue", n: str = "n") -> Column:
    return ratio(F.sum(value), F.sum(n))


def _distinct(sketch: str = "customers") -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))


def hourly_distribution(cells: DataFrame) -> DataFrame:
    per = _of(cells, "hour_all").groupBy(F.col("k1").cast("bigint").alias("hour_of_day")).agg(
        _n().alias("transaction_count"), _revenue().alias("total_revenue"), _distinct().alias("unique_customers")
    )
    return ranking.order_by(per, "hour_of_day")


def yearly_customers(cells: DataFrame) -> DataFrame:
    per = _of(cells, "price").groupBy(F.year("day").cast("bigint").alias("year")).agg(
        _distinct().alias("unique_customers"), _revenue().alias("total_revenue")
    )
    return ranking.order_by(per, "year")


def sales_by_country(cells: DataFrame) -> DataFrame:
    per = _of(cells, "country").groupBy(F.col("k1").alias("country")).agg(
        _n().alias("total_transactions"), _revenue().alias("total_revenue"), _mean().alias("avg_transaction_value"),
        _distinct().alias("unique_customers"), _distinct("others").alias("unique_products"),
    )
    return ranking.order_by(per, "-total_revenue", "country")


def hourly_sales(cells: DataFrame) -> DataFrame:
    per = _of(cells, "hour").groupBy(F.col("k1").cast("bigint").alias("hour")).agg(
        _n().alias("total_transactions"), _revenue().alias("total_revenue"), _mean().alias("avg_transaction_value"),
        _distinct().alias("unique_customers"), _distinct("others").alias("unique_receipts"),
    )
    return ranking.order_by(per, "hour")


def discount_periods(cells: DataFrame) -> DataFrame:
    per = _of(cells, "period").groupBy(F.col("k1").alias("discount_period")).agg(
        _n().alias("transactions"), _revenue().alias("revenue"), _mean().alias("avg_transaction"), _distinct().alias("customers")
    )
    return ranking.order_by(per, "-revenue", "discount_period")


def regular_vs_discount(cells: DataFrame) -> DataFrame:
    per = _of(cells, "price").groupBy(F.col("k1").alias("price_type")).agg(
        _n().alias("transactions"), _revenue().alias("revenue"), _mean().alias("avg_transaction"), _distinct().alias("customers")
    )
    return ranking.order_by(groups.share_of_total(per, "transactions", "transaction_percentage"), "-revenue", "price_type")


def age_by_country(cells: DataFrame) -> DataFrame:
    per = _of(cells, "age").groupBy(F.col("k1").alias("country"), F.col("k2").alias("age_group")).agg(
        _n().alias("total_transactions"), _revenue().alias("total_revenue"), _mean().alias("avg_transaction_value"),
        _distinct().alias("unique_customers"), _mean("sum_age").alias("avg_age_in_group"),
    )
    return ranking.order_by(per, "country", "age_group")


def product_performance(cells: DataFrame) -> DataFrame:
    per = _of(cells, "product").groupBy(F.col("k1").alias("product_name")).agg(
        _n().alias("total_transactions"), _revenue().alias("total_revenue"), _mean().alias("avg_transaction_value"),
        _distinct().alias("unique_customers"), _distinct("others").alias("countries_sold_in"),
        F.sum("n_discounted").cast("bigint").alias("discounted_sales"),
        _mean("discounted_revenue", "n_discounted").alias("avg_discounted_price"),
    )
    return ranking.order_by(per, "-total_revenue", "product_name")


# The analyses of the export bundle, from cells.
BUNDLE = {
    "sales_summary_by_country": sales_by_country,
    "hourly_sales_analysis": hourly_sales,
    "discount_periods_analysis": discount_periods,
    "regular_vs_discount_comparison": regular_vs_discount,
    "age_group_analysis": age_by_country,
    "product_performance_analysis": product_performance,
}


def export_bundle(cells: DataFrame, folder: str, single_file: bool = False) -> dict[str, str]:
    """Write the bundle, one CSV folder per analysis, without a look at the sales."""
    return export_all({name: report(cells) for name, report in BUNDLE.items()}, folder, single_file)
