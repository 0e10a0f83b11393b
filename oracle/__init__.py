"""Expected results of every query, as SQL for an independent engine.

Each text reads the given tables only and is written apart from the Spark code:
the discount calendar is a table of days here, deciles are a plain NTILE over
all rows, highlights are one sorted LIMIT 1 per measure.
"""

from __future__ import annotations

from oracle.base import with_sales
from oracle.reports import REPORT_SQL
from oracle.steps import STEP_SQL
from oracle.tables import TABLE_SQL


def oracle_sql() -> dict[str, str]:
    return {name: with_sales(body) for name, body in {**REPORT_SQL, **STEP_SQL, **TABLE_SQL}.items()}
