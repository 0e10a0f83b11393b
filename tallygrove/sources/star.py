"""The sales table derived from order, customer, nation and part tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.operators.enrich import enrich_sales
from tallygrove.schema import MONTH_PARTITION, SALES_SCHEMA
from tallygrove.session import shared_dir, sized_tasks
from tallygrove.sources.sinks import arranged_by


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sales row per order line."""
    return _sales_columns(_order_lines(spark, sf_dir))


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, with the keys and figures from which its texts follow.

    Orders meet customers before they meet their lines, so the
    largest table is shuffled for the order key and the part key only. What can be worked out
    from a key (texts, age, income) is left to :func:`_sales_columns`: these rows
    are sorted and shuffled at less than two thirds of the width. Nothing
    is hinted: Spark broadcasts a side it measures to be small, and splits a
    skewed key (one customer or part with many orders) at run time.
    """
    money = "decimal(10,2)"
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast(money).alias("receipt_total_sgd")
    )
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    parts = _table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("product_name"), F.col("p_retailprice").cast(money).alias("unit_price_sgd")
    )
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("units_sold"),
        F.col("l_extendedprice").cast(money).alias("total_amount_per_product_sgd"), "l_returnflag",
    )
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    rows = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    rows = rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey")
    hours = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5, F.lit(24)).cast("int")
    return rows.withColumn("date", F.timestamp_add("HOUR", hours, "o_orderdate")).drop("o_orderdate")


def _sales_columns(lines: DataFrame, *more: str) -> DataFrame:
    """The sales columns of :func:`_order_lines`, and ``more`` of its own."""
    money = "decimal(10,2)"
    buyer, key, flag = F.col("o_custkey"), F.col("l_orderkey"), F.col("l_returnflag")
    return lines.select(
        "date",
        (key * 10 + F.col("l_linenumber")).cast("string").alias("transaction_id"),
        F.when(flag == "N", "Product Sale")
        .when(flag == "R", "Product Refund")
        .otherwise("Product Exchange")
        .alias("transaction_desc"),
        buyer.cast("string").alias("customer_id"),
        F.when(buyer % 97 != 0, (16 + buyer * 37 % 70).cast("int")).alias("age"),
        F.when(buyer % 101 != 0, F.when(buyer % 2 == 0, "M").otherwise("F")).alias("gender"),
        key.cast("string").alias("receipt_number"),
        F.col("l_partkey").cast("string").alias("product_id"),
        "product_name",
        "units_sold",
        "unit_price_sgd",
        "total_amount_per_product_sgd",
        "receipt_total_sgd",
        F.concat(
            F.lit("C"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0")
        ).alias("country_id"),
        "country",
        F.concat_ws("-", "country", (buyer % 3).cast("string")).alias("city"),
        F.when(buyer % 89 == 0, None)
        .when(buyer % 50 == 0, F.lit("60000.50").cast(money))
        .otherwise((20000 + buyer * 977 % 130000).cast(money))
        .alias("income"),
        *more,
    )


def source_name(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Named by the folder and by size and time of its files: new files, new copy."""
    seen = [sf_dir]
    for name in ("orders", "customer", "nation", "part", "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        seen.append(f"{fs.getContentSummary(path).getLength()}@{fs.getFileStatus(path).getModificationTime()}")
    return f"tallygrove_{kind}_{hashlib.sha256('|'.join(seen).encode()).hexdigest()[:16]}"


def stored_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales table, written once per application and scanned by every report.

    The joins run once instead of once per report. Rows are laid out before their texts are
    made, which halves what is moved and sorted. The copy lies in the shared
    folder, partitioned by month, so it survives the loss of executors and a
    report reads only its columns and months. A temp view remembers it, which
    also keeps the file listing.
    """
    view = source_name(spark, sf_dir, "sales")
    if not spark.catalog.tableExists(view):
        path = f"{shared_dir(spark)}/sales-{uuid.uuid4().hex[:12]}"
        lines = arranged_by(_order_lines(spark, sf_dir), MONTH_PARTITION)
        with sized_tasks(spark):
            _sales_columns(lines, MONTH_PARTITION).write.partitionBy(MONTH_PARTITION).parquet(path)
        spark.read.schema(_stored_schema()).parquet(path).createOrReplaceTempView(view)
    return spark.table(view)


def _stored_schema() -> str:
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SALES_SCHEMA)
    return f"{cols}, {MONTH_PARTITION} date"


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched sales table of the given folder, as a temp view as well."""
    view = source_name(spark, sf_dir, "enriched")
    if not spark.catalog.tableExists(view):
        enrich_sales(stored_sales(spark, sf_dir)).createOrReplaceTempView(view)
    return spark.table(view)
