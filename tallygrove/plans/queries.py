"""Queries over a folder of source tables: every report by name, with the
parameters used to try it, and the operators the reports are built from."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tallygrove.plans.registry import REPORTS
from tallygrove.plans.steps import STEPS
from tallygrove.plans.tables import TABLES
from tallygrove.sources.star import report_table

Query = Callable[[SparkSession, str], DataFrame]

_PAGE = {"start_date": "1996-01-01", "end_date": "1999-12-31", "min_age": 25, "max_age": 65}
_RECENT = {"min_year": 1998}

PARAMETERS: dict[str, dict] = {
    "sales_page": {"page": 3, "page_size": 50, **_PAGE},
    "sales_page_total": {"start": _PAGE["start_date"], "end": _PAGE["end_date"], "min_age": 25, "max_age": 65},
    "sales_by_date": {"day": "1996-07-04"},
    "customer_totals": {"customer_id": "7"},
    "customer_recent": {"customer_id": "7"},
    "receipt_items": {"receipt_number": "20"},
    "recent_top_products": _RECENT,
    "product_country_recent": _RECENT,
    "product_country_matrix": _RECENT,
    "yearly_discounts": _RECENT,
    "top5_recent_products": _RECENT,
    "yearly_growth": _RECENT,
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REPORTS[name](report_table(spark, sf_dir), **PARAMETERS.get(name, {}))


QUERIES: dict[str, Query] = {name: partial(_run, name) for name in REPORTS} | STEPS | TABLES
