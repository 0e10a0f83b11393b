"""Shared by the operators: reading the text tables and cutting lineage."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.session import shared_dir

# White space that separates words: blank and the five control characters.
SPACE = r"[\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once per application: Spark's driver serves it
    to the executors as a zip. Needed where it is not installed on them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tallygrove-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/tallygrove-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns cannot clash with results.
    A null text is an empty one; a null id stays null."""
    ship_package(df.sparkSession)
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def words(text: Column) -> Column:
    """Words of a text in order; none in an empty text."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the
    body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back. The rows survive
    the loss of executors and are computed once, however often they are used."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like :func:`cut`, with the rows dealt and sorted by a key: joins on it move the other side alone."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path)
    writer.option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unique_ids(df: DataFrame, name: str = "row_key") -> DataFrame:
    """``df`` with a column ``row_key`` (or of another name, which must be free): the doc_id where all ids
    are present and differ, else a number per row, fixed by writing the rows once."""
    twice = df.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if twice.isEmpty():
        return df.withColumn(name, F.col("doc_id"))
    return cut(df.withColumn(name, F.monotonically_increasing_id()), "rows")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
