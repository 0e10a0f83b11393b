"""Time every report. Prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) is the folder of source
tables, ``BENCH_CPUS`` the number of local cores. The sales table is built and
stored first, timed as ``stored_sales``; then each query runs once on the warm
session, all of its rows computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tallygrove.plans.queries import QUERIES  # noqa: E402
from tallygrove.plans.registry import REPORTS  # noqa: E402
from tallygrove.session import get_spark  # noqa: E402
from tallygrove.sources.star import stored_sales  # noqa: E402

# Operator queries timed beside the reports.
OPERATORS = [
    "deciles", "medians", "discount_tagged", "geo_enriched", "clean_sanitize", "top_per_country",
    "interval_tagged", "interval_totals", "lookup_hot_city", "upsert_months", "page_indexed",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_spark(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {"stored_sales": timed(lambda: stored_sales(spark, sf_dir))}

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("hourly_sales")  # warm-up
    for name in [*REPORTS, *OPERATORS]:
        seconds[name] = timed(lambda: run(name))
    base = os.path.basename(sf_dir)
    print(
        json.dumps(
            {
                "metric": "total seconds of all reports, sales table build included",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(base[2:]) if base.startswith("sf") else base,
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
