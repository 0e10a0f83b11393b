"""Left joins with a table of one row per key, whatever its size and however skewed the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.sources.stored import stored

BROADCAST_ROWS = 100_000  # a lookup of so many rows is broadcast
HEAVY = 1_000  # a key with more than one row in so many is heavy; there are fewer heavy keys than this


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key) with more than 1/HEAVY of the rows, found by a count that is combined before the
    shuffle. Nulls are not listed."""
    counts = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.filter((F.col("_n") * HEAVY > total) & F.col(key).isNotNull()).select(key)


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, broadcast_rows: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``lookup`` (one row per key), nulls where the key is not listed.

    The lookup is written once and counted. If it is small it is broadcast, and no row is
    shuffled. If not, the heavy keys are counted out first: their entries, fewer than HEAVY,
    are broadcast to the rows that have them, and only rows of the many light keys
    meet the lookup in a shuffle. Rows without a key are not joined at all.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    entries = stored(lookup, "lookup")
    if entries.count() <= limit:
        return rows.join(F.broadcast(entries), key, "left")
    heavy = F.broadcast(stored(heavy_keys(rows, key), "heavy-keys"))
    light_rows = rows.filter(F.col(key).isNotNull()).join(heavy, key, "left_anti")
    heavy_rows = rows.join(heavy, key, "left_semi").join(F.broadcast(entries.join(heavy, key, "left_semi")), key, "left")
    # a shuffle join whatever the lookup's files weigh: its size in memory was judged by its rows
    joined = light_rows.join(entries.hint("merge"), key, "left")
    missing = [F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in entries.columns if c != key]
    unknown = rows.filter(F.col(key).isNull()).select("*", *missing)
    return joined.unionByName(heavy_rows).unionByName(unknown)
