"""Copies of a table for look-ups of single keys: dealt into buckets by the key and sorted by it.

A look-up by equality reads the files of one bucket, and in them the row groups that can
hold the key. The rows of a key that is very common are dealt over several files of its bucket. A copy
describes itself in a small file, so any session can open it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallygrove.session import sized_tasks
from tallygrove.sources.storage import Folder

DESCRIPTION = "_copy.json"


def write_copy(df: DataFrame, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write the rows below ``path``, which must be new, and open the copy. The number of buckets is
    that of shuffle partitions unless given."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = Folder(spark, path)
    if folder.exists():
        raise ValueError(f"{path} exists")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled") == "true"
    dealt = df.hint("rebalance", n, key) if adaptive else df.repartition(n, key)
    name = f"writing_{uuid.uuid4().hex}"
    with sized_tasks(spark):
        dealt.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    folder.create(DESCRIPTION, json.dumps({"key": key, "buckets": n, "schema": df.schema.simpleString()}))
    return open_copy(spark, path)


def open_copy(spark: SparkSession, path: str) -> DataFrame:
    """The copy at a path, with its layout known to Spark."""
    about = json.loads(Folder(spark, path).read(DESCRIPTION))
    name, key = f"copy_{uuid.uuid4().hex}", about["key"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _fields(spark, about["schema"]))
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {about['buckets']} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def _fields(spark: SparkSession, schema: str):
    return spark.createDataFrame([], schema).schema.fields
