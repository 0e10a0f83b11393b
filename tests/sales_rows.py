"""Rows of the sales table for tests."""

import datetime as dt
from decimal import Decimal

from tallygrove.schema import SALES_SCHEMA


def sale(i=1, **values):
    """A sales row with defaults; keyword arguments replace single columns."""
    row = {
        "date": dt.datetime(2024, 3, 4, 10, 0),
        "transaction_id": str(i),
        "transaction_desc": "Product Sale",
        "customer_id": "c1",
        "age": 30,
        "gender": "F",
        "receipt_number": str(i),
        "product_id": "p1",
        "product_name": "Pen",
        "units_sold": 1,
        "unit_price_sgd": Decimal("10.00"),
        "total_amount_per_product_sgd": Decimal("10.00"),
        "receipt_total_sgd": Decimal("10.00"),
        "country_id": "C001",
        "country": "Aland",
        "city": "Arbor",
        "income": Decimal("40000.00"),
    }
    if "amt" in values:
        values["total_amount_per_product_sgd"] = Decimal(str(values.pop("amt")))
    row.update(values)
    return tuple(row[c] for c in SALES_SCHEMA.fieldNames())
