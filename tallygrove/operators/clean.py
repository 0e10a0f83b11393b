"""Column typing and cleaning of raw sales rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallygrove.functions.calendar import parse_timestamp
from tallygrove.schema import SALES_COLUMNS, SALES_SCHEMA

_INTEGER_COLUMNS = ["age", "units_sold"]
_AMOUNT_COLUMNS = ["unit_price_sgd", "total_amount_per_product_sgd", "receipt_total_sgd"]
_MONEY_COLUMNS = [*_AMOUNT_COLUMNS, "income"]


def ensure_columns(df: DataFrame, required: Sequence[str] = SALES_COLUMNS) -> DataFrame:
    """The required columns in the required order; a missing one is filled
    with the text ``default_<name>``."""
    present = set(df.columns)
    return df.select(
        [F.col(c) if c in present else F.lit(f"default_{c}").alias(c) for c in required]
    )


def lenient_int(c: Column) -> Column:
    """Text as integer: fractions are rounded, anything unreadable is null."""
    return F.round(c.try_cast("decimal(38,10)")).try_cast("int")


def sanitize_sales(df: DataFrame, reset_amounts: bool = False) -> DataFrame:
    """Safe casts to the sales schema. Numbers that cannot be read become 0, a
    date that cannot be read becomes null. ``reset_amounts`` sets the three
    amount columns to zero."""
    out = []
    for field in SALES_SCHEMA:
        text = F.col(field.name).cast("string")
        if field.name == "date":
            c = text.try_cast("timestamp_ntz")
        elif field.name in _INTEGER_COLUMNS:
            c = F.coalesce(lenient_int(text), F.lit(0))
        elif field.name in _MONEY_COLUMNS:
            zero = F.lit(0).cast(field.dataType)
            if reset_amounts and field.name in _AMOUNT_COLUMNS:
                c = zero
            else:
                c = F.coalesce(text.try_cast(field.dataType), zero)
        else:
            c = text
        out.append(c.alias(field.name))
    return df.select(out)


def _typed(name: str, declared: str) -> Column:
    c = F.col(name)
    declared = declared.lower()
    if "date" in name.lower() or "time" in name.lower():
        return parse_timestamp(c.cast("string"))
    if "integer" in declared:
        return c.try_cast("bigint")
    if "float" in declared:
        return c.try_cast("double")
    if "character" in declared or "string" in declared:
        return c.cast("string")
    return c


def apply_type_map(df: DataFrame, types: Mapping[str, str | Mapping[str, str]]) -> DataFrame:
    """Apply a user's column -> type map. A column whose name contains ``date``
    or ``time`` becomes a timestamp whatever its declared type; values that do
    not fit become null; columns outside the map, or with an unknown type, stay
    as they are. A map entry may be a parameter row, whose ``value`` counts."""
    out = []
    for name in df.columns:
        declared = types.get(name)
        if isinstance(declared, Mapping):
            declared = declared.get("value", "")
        c = _typed(name, declared) if isinstance(declared, str) else F.col(name)
        out.append(c.alias(name))
    return df.select(out)


def apply_json_map(df: DataFrame, path: str) -> DataFrame:
    """:func:`apply_type_map` with the map read from a JSON object file."""
    row = df.sparkSession.read.option("multiLine", True).json(path).first()
    types = {k: v.asDict() if isinstance(v, Row) else v for k, v in row.asDict().items()}
    return apply_type_map(df, {k: v for k, v in types.items() if v is not None})


def stage_as_strings(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def typed_from_staging(df: DataFrame) -> DataFrame:
    """Staged text as typed sales rows. Strict: a value that does not fit its
    column fails the job (ANSI casts)."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SALES_SCHEMA])
