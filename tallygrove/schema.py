"""The sales fact table: one row per product line of a receipt."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(10, 2)

SALES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("transaction_desc", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("receipt_number", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("units_sold", T.IntegerType()),
        T.StructField("unit_price_sgd", _MONEY),
        T.StructField("total_amount_per_product_sgd", _MONEY),
        T.StructField("receipt_total_sgd", _MONEY),
        T.StructField("country_id", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("income", _MONEY),
    ]
)

SALES_COLUMNS = SALES_SCHEMA.fieldNames()

AMOUNT = "total_amount_per_product_sgd"
SALE = "Product Sale"

# Order that makes every "top k rows" result stable: with the amount it
# identifies a row.
ROW_ID = ["transaction_id", "product_id", AMOUNT]

# Partition columns the sinks add. They are derived from ``date`` and never
# part of a report.
MONTH_PARTITION = "sale_month"
DAY_PARTITION = "sale_date"

# Totals have 38 digits, 36 of them before the point: amounts are widened to 28 digits
# before they are added.
TOTAL_TYPE = T.DecimalType(38, 2)
