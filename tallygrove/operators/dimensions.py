"""Small tables joined to the sales, and keyed updates of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.calendar import DISCOUNT_PERIODS, november_friday
from tallygrove.operators.lookup import lookup_join

PARAMETER_COLUMNS = ["key", "value", "alternative_key", "alternative_value"]

# A dimension is only forced to be broadcast when it has at most this many rows.
BROADCAST_ROWS = 100_000


def upsert_by_key(
    base: DataFrame, new: DataFrame, key: str | Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """One row per key: of ``new`` where it has the key, else of ``base``. Of
    several rows with a key the last one by ``order`` counts, then by all columns. A null key is a
    key like others."""
    keys = [key] if isinstance(key, str) else list(key)
    place = [*order, *[c for c in base.columns if c not in order]]
    rows = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*base.columns), F.struct("_new", *place)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(last).select("_row.*")


def country_code_parameters(codes: DataFrame) -> DataFrame:
    """(code, country) rows in the shape of the parameter table."""
    return codes.select(
        F.concat(F.lit("countries_"), "code").alias("key"),
        F.lit("character 2").alias("value"),
        F.col("code").alias("alternative_key"),
        F.col("country").alias("alternative_value"),
    )


def discount_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Discount periods of each year, in order of precedence.

    New Year starts on Dec 26 of the year before, so to cover sales up to the
    end of a year the calendar must reach one year further.
    """
    y = F.col("year").cast("int")
    friday = november_friday(y)
    monday = F.date_add(friday, 3)
    spans = [
        (friday, friday),
        (monday, monday),
        (F.make_date(y - 1, F.lit(12), F.lit(26)), F.make_date(y, F.lit(1), F.lit(2))),
        (F.make_date(y, F.lit(12), F.lit(1)), F.make_date(y, F.lit(12), F.lit(26))),
    ]
    periods = F.array(
        *[
            F.struct(
                F.lit(prio).alias("prio"),
                F.lit(name).alias("discount_period"),
                start.alias("start_d"),
                end.alias("end_d"),
            )
            for prio, (name, (start, end)) in enumerate(zip(DISCOUNT_PERIODS, spans), 1)
        ]
    )
    years = spark.range(first_year, last_year + 1, numPartitions=1).toDF("year")
    return years.select(F.inline(periods))


def calendar_days(calendar: DataFrame) -> DataFrame:
    """One row per covered day: the period of lowest ``prio`` wins."""
    days = calendar.select(
        F.explode(F.sequence("start_d", "end_d")).alias("day"), "prio", "discount_period"
    )
    return days.groupBy("day").agg(F.min_by("discount_period", "prio").alias("discount_period"))


def enrich_geo(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Add country and country_id of each row's city; cities that are not
    listed get nulls. A name listed twice keeps its first entry by country id,
    so no sale is doubled.

    Cities are reduced to their distinct entries by a hash aggregate first, then joined by
    :func:`lookup_join`: broadcast if counted to be few, else with the hot cities kept out of
    the shuffle, as a few cities hold most sales.
    """
    entry = [F.col("name").alias("city"), F.col("country_id").cast("string").alias("country_id"), "country"]
    distinct = cities.select(*entry).groupBy("city", "country_id", "country").agg(F.count("*").alias("_n"))
    lookup = (
        distinct.groupBy("city")
        .agg(F.min(F.struct("country_id", "country")).alias("c"))
        .select("city", "c.country", "c.country_id")
    )
    return lookup_join(df.drop("country", "country_id"), lookup, "city", BROADCAST_ROWS)


def date_spine(spark: SparkSession, start: str, end: str, name: str = "sale_date") -> DataFrame:
    """Every day from start to end, both included."""
    return spark.range(1, numPartitions=1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(name)
    )


def fill_missing_days(
    daily: DataFrame, start: str | None = None, end: str | None = None, day: str = "sale_date"
) -> DataFrame:
    """Daily rows, and zeros for each day of the range that has none. The range
    is that of the rows unless given; rows outside of it, and without a day, stay."""
    if start is None or end is None:
        first, last = daily.agg(F.min(day), F.max(day)).first()
        start, end = start or first, end or last
    if start is None or end is None:
        return daily
    spine = date_spine(daily.sparkSession, str(start), str(end), day)
    numbers = [f.name for f in daily.schema if f.dataType.typeName() in _NUMERIC]

    def shown(c: str) -> Column:
        if c not in numbers:
            return F.col(c)
        zero = F.lit(0).cast(daily.schema[c].dataType)
        return F.when(F.col("_given").isNull(), zero).otherwise(F.col(c)).alias(c)

    joined = spine.join(daily.withColumn("_given", F.lit(True)), day, "full_outer")
    return joined.select(day, *[shown(c) for c in daily.columns if c != day])


_NUMERIC = {"decimal", "double", "float", "integer", "long", "short", "byte"}
