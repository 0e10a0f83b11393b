"""File scans. CSV follows the usual conventions: doubled quotes, blanks kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from tallygrove.schema import SALES_SCHEMA
from tallygrove.sources.versions import VersionedTable, is_versioned

BAD_ROW = "_bad_row"

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_sales(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The stored fact table, the latest version of it if it is kept in versions; partition
    columns the sinks added come last. A path that does not exist yet is an empty table."""
    try:
        df = VersionedTable(spark, path).read() if is_versioned(spark, path) else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], SALES_SCHEMA)
    return df.select(*columns) if columns else df


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    multi_line: bool = False,
    sep: str = ",",
    bad_rows: str = "fail",
) -> DataFrame:
    """CSV with a header. Types are inferred (one extra pass over the files)
    unless a schema is given. ``multi_line`` allows line breaks inside quoted
    fields; such a file cannot be split, so it is off by default.

    With a schema every file's header must name its columns in that order, else
    the read fails. A row that does not fit (a bad value, too few fields) fails the
    read too; ``bad_rows="keep"`` gives it nulls instead and its text in the further column
    ``_bad_row``.
    """
    if bad_rows not in ("fail", "keep"):
        raise ValueError("bad_rows is fail or keep")
    reader = spark.read.options(**CSV_OPTIONS).option("sep", sep).option("multiLine", multi_line)
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.options(**strict_options(bad_rows)).schema(with_bad_row(schema, bad_rows))
    return reader.csv(list(path) if not isinstance(path, str) else path)


def strict_options(bad_rows: str = "fail") -> dict[str, str]:
    """Headers are checked, bad rows fail or are kept aside."""
    if bad_rows == "fail":
        return {"enforceSchema": "false", "mode": "FAILFAST"}
    return {"enforceSchema": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW}


def with_bad_row(schema: StructType | str, bad_rows: str) -> StructType | str:
    if bad_rows == "fail":
        return schema
    if isinstance(schema, str):
        return f"{schema}, {BAD_ROW} string"
    return StructType([*schema.fields, StructField(BAD_ROW, StringType())])


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON document: an object or an array of objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many Parquet files, folders or tables kept in versions as one table."""
    kept = [p for p in paths if is_versioned(spark, p)]
    plain = [p for p in paths if p not in kept]
    parts = [VersionedTable(spark, p).read() for p in kept] + ([spark.read.parquet(*plain)] if plain else [])
    return reduce(DataFrame.unionByName, parts)
