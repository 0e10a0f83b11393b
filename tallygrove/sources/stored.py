"""Results written to the shared folder: computed once, safe from lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tallygrove.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
