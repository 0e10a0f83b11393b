"""Reports by name, and the registry of named views.

A view is run by its name; it can be registered as a temp view for SQL, and its
result saved as CSV under its name and a time stamp.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallygrove.plans import api, daily, discount, exports, insights, misc, retail, summary
from tallygrove.sources.sinks import export_all, export_csv

Report = Callable[..., DataFrame]


@dataclass(frozen=True)
class View:
    name: str
    description: str
    report: Report


# The names under which users know the views.
VIEWS = {
    v.name: v
    for v in [
        View(
            "Monthly Sales Trends",
            "Revenue, customers and their growth over the months",
            api.monthly_trends,
        ),
        View(
            "Customer Demographics Analysis",
            "What customers of each age group and gender spend",
            api.customer_demographics,
        ),
        View(
            "Top Products by Revenue",
            "Products with the largest revenue, their sales and buyers",
            api.top_products,
        ),
        View(
            "Hourly Sales Distribution",
            "Sales, revenue and customers per hour of the day",
            api.hourly_distribution,
        ),
        View(
            "Geographic Sales Distribution",
            "Countries in the order of their revenue",
            api.geographic_distribution,
        ),
        View(
            "High-Value vs Low-Value Transactions",
            "The largest and the smallest tenth of sales beside each other",
            api.value_transactions,
        ),
        View(
            "Income Level Analysis",
            "Customers and purchases per income segment",
            api.income_levels,
        ),
    ]
}


def file_stem(name: str, when: dt.datetime) -> str:
    """View name with anything but letters and digits replaced, plus the time."""
    clean = "".join(c if c.isalnum() else "_" for c in name)
    return f"{clean}_{when:%Y%m%d_%H%M%S}"


def run_view(
    name: str,
    df: DataFrame,
    save_to: str | None = None,
    when: dt.datetime | None = None,
    single_file: bool = False,
) -> DataFrame:
    """Run a view over the enriched table. With ``save_to``, the result is also
    written as CSV below that folder."""
    out = VIEWS[name].report(df)
    if save_to:
        export_csv(out, f"{save_to}/{file_stem(name, when or dt.datetime.now())}", single_file)
    return out


def register_views(df: DataFrame) -> list[str]:
    """Make every view available to SQL as a temp view."""
    names = []
    for view in VIEWS.values():
        name = "".join(c if c.isalnum() else "_" for c in view.name).lower()
        view.report(df).createOrReplaceTempView(name)
        names.append(name)
    return names


# The analyses of the export bundle.
EXPORT_BUNDLE: dict[str, Report] = {
    "sales_summary_by_country": exports.sales_by_country,
    "hourly_sales_analysis": exports.hourly_sales,
    "discount_periods_analysis": exports.discount_periods,
    "regular_vs_discount_comparison": exports.regular_vs_discount,
    "age_group_analysis": exports.age_by_country,
    "product_performance_analysis": exports.product_performance,
}


def export_bundle(df: DataFrame, folder: str, single_file: bool = False) -> dict[str, str]:
    """Write the bundle, one CSV folder per analysis."""
    reports = {name: report(df) for name, report in EXPORT_BUNDLE.items()}
    return export_all(reports, folder, single_file)


_MODULES = [api, exports, summary, daily, discount, retail, insights, misc]

# Every report: public functions of the plan modules, by name.
REPORTS: dict[str, Report] = {
    name: fn
    for module in _MODULES
    for name, fn in vars(module).items()
    if callable(fn)
    and not name.startswith("_")
    and getattr(fn, "__module__", None) == module.__name__
    and name not in ("price_type", "concentration", "product_country_pivot")
}
