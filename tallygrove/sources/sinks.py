"""Writing: exports, splitting and rebuilding files, fact table updates.

Everything is written by the executors; no rows pass through the driver, and a
single output file is made only when asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.calendar import month_start
from tallygrove.schema import DAY_PARTITION, MONTH_PARTITION, SALES_COLUMNS
from tallygrove.session import brief_shuffles, sized_tasks
from tallygrove.sources.files import CSV_OPTIONS, read_csv, read_parts
from tallygrove.sources.versions import CHUNK, VersionedTable

ROWS_PER_PART = 10_000

# Of a CSV file, unless a single file is asked for: some 75 MB of sales. A file with line breaks inside fields
# cannot be split by who reads it, so its size bounds a task.
ROWS_PER_FILE = 500_000

# Columns by which single sales are looked up.
LOOKUP_COLUMNS = ["customer_id", "receipt_number", "product_id"]


def _csv_writer(df: DataFrame, sep: str = ",", encoding: str = "UTF-8", single_file: bool = False):
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    return writer.options(**CSV_OPTIONS, sep=sep, encoding=encoding, maxRecordsPerFile=0 if single_file else ROWS_PER_FILE)


def export_csv(df: DataFrame, path: str, single_file: bool = False, compression: str = "none") -> str:
    """Write as CSV with a header in each part."""
    with brief_shuffles(df.sparkSession):
        _csv_writer(df, single_file=single_file).option("compression", compression).csv(path)
    return path


def export_complete(df: DataFrame, path: str, compression: str = "none") -> str:
    """The whole sales table, its own columns only."""
    return export_csv(df.select(SALES_COLUMNS), path, compression=compression)


def split_csv(
    spark: SparkSession,
    src: str | Sequence[str],
    dst: str,
    rows: int = ROWS_PER_PART,
    schema=None,
    multi_line: bool = True,
) -> str:
    """Split CSV files into parts of at most ``rows`` rows, each with the
    header. Read as text columns, so values come through unchanged. A source
    without line breaks inside fields is read faster without ``multi_line``, as
    Spark can then split its files. Very large tables want large parts."""
    df = read_csv(spark, src, schema or _text_schema(spark, src), multi_line)
    _csv_writer(df).option("maxRecordsPerFile", rows).csv(dst)
    return dst


def _text_schema(spark: SparkSession, src: str | Sequence[str]) -> str:
    head = spark.read.options(**CSV_OPTIONS).csv(src if isinstance(src, str) else list(src))
    return ", ".join(f"`{c}` string" for c in head.columns)


def csv_to_parquet(
    spark: SparkSession,
    src: str | Sequence[str],
    dst: str,
    rows: int = ROWS_PER_PART,
    schema=None,
    multi_line: bool = True,
) -> str:
    """CSV to Parquet parts of at most ``rows`` rows."""
    df = read_csv(spark, src, schema, multi_line)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(dst)
    return dst


def rebuild_csv(
    spark: SparkSession,
    parts: str | Sequence[str],
    dst: str,
    single_file: bool = False,
    multi_line: bool = True,
) -> str:
    """Put CSV parts back together; every row of every part is kept. Parts whose
    headers differ are refused."""
    df = read_csv(spark, parts, _text_schema(spark, parts), multi_line)
    return export_csv(df, dst, single_file)


def rebuild_parquet(
    spark: SparkSession, parts: str | Sequence[str], dst: str, single_file: bool = False
) -> str:
    """Put Parquet parts together as CSV."""
    paths = [parts] if isinstance(parts, str) else list(parts)
    return export_csv(read_parts(spark, paths), dst, single_file)


def rebuild_from_manifest(
    spark: SparkSession,
    manifest: str,
    dst: str,
    fmt: str = "csv",
    sep: str = ",",
    encoding: str = "UTF-8",
    codec: str | None = None,
    single_file: bool = False,
) -> str:
    """Rebuild the Parquet chunks a manifest lists (paths relative to it), as
    CSV or as Parquet. The codec is the given one, else the manifest's, else
    zstd."""
    if fmt not in ("csv", "parquet"):
        raise ValueError("output format must be csv or parquet")
    doc = spark.read.option("multiLine", True).json(manifest)
    row = doc.select(
        F.col("chunks.file").alias("files"),
        (F.col("compression") if "compression" in doc.columns else F.lit(None)).alias("codec"),
    ).first()
    folder = manifest.rsplit("/", 1)[0] if "/" in manifest else "."
    df = read_parts(spark, [f"{folder}/{f}" for f in row["files"]])
    if fmt == "parquet":
        df = df.coalesce(1) if single_file else df
        df.write.mode("overwrite").option("compression", codec or row["codec"] or "zstd").parquet(dst)
    else:
        _csv_writer(df, sep, encoding, single_file).csv(dst)
    return dst


def pack_csv(df: DataFrame, dst: str) -> str:
    """CSV parts packed with zlib."""
    _csv_writer(df).option("compression", "deflate").csv(dst)
    return dst


def unpack_csv(spark: SparkSession, src: str, schema=None) -> DataFrame:
    """Packed CSV parts; the codec follows from the file name. Packed files are
    never split, so line breaks inside fields cost nothing."""
    return read_csv(spark, src, schema, multi_line=True)


def _arranged(df: DataFrame, by: str, laid_out: bool = False) -> DataFrame:
    """Sales rows, and their chunk if they have one, laid out for writing."""
    return arranged_by(df.select(*SALES_COLUMNS, *[c for c in [CHUNK] if c in df.columns]), by, laid_out)


def arranged_by(df: DataFrame, by: str, laid_out: bool = False) -> DataFrame:
    """Add the partition column and lay the rows out for writing: each value of
    it together and sorted by date, so that row-group statistics prune well. The
    rebalance lets Spark size the files: small values share a task, a value with
    very many rows is split over several. Rows that come from files ``laid_out`` so are not shuffled again: a task
    takes whole files, so it makes no more of them than it reads."""
    rows = df.withColumn(by, partition_value(by))
    if laid_out:
        return rows.sortWithinPartitions(by, "date")
    # Without adaptive execution the hint does nothing.
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    rows = rows.hint("rebalance", F.col(by)) if adaptive else rows.repartition(by)
    return rows.sortWithinPartitions(by, "date")


def partition_value(by: str) -> Column:
    return month_start("date") if by == MONTH_PARTITION else F.to_date("date")


def _fact_writer(df: DataFrame, by: str, bloom: Sequence[str] = ()):
    """Writer of the fact table. Bloom filters on id columns (``bloom``, such as
    LOOKUP_COLUMNS) let a lookup of one customer, receipt or product skip the row groups
    without it. They cost a third of the writing time and size, so they are
    for tables that are looked up often."""
    writer = _arranged(df, by).write.mode("overwrite").partitionBy(by)
    for name in bloom:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    return writer


def write_partitioned(df: DataFrame, path: str, by: str = MONTH_PARTITION, bloom: Sequence[str] = ()) -> str:
    """Replace the fact table, with one folder per month (or day)."""
    with sized_tasks(df.sparkSession):
        _fact_writer(df, by, bloom).parquet(path)
    return path


def sales_table(spark: SparkSession, path: str, by: str = MONTH_PARTITION, bloom: Sequence[str] = ()) -> VersionedTable:
    """The fact table kept in versions, with one folder per month (or day) and stored counts per day."""
    return VersionedTable(spark, path, by, _arranged, "date", bloom)


def append_sales(df: DataFrame, path: str, chunk: str, by: str = DAY_PARTITION, bloom: Sequence[str] = ()) -> str:
    """Add a chunk to a fact table made of chunks, as its next version. Loading a chunk again
    replaces its own rows and no others, whatever days it holds, undated rows
    included. Readers see the version before until the chunk is there as a whole."""
    sales_table(df.sparkSession, path, by, bloom).append(df.select(SALES_COLUMNS), chunk)
    return path


def replace_table(df: DataFrame, path: str) -> str:
    """Replace the stored table by these rows, as its next version: readers go on with the version
    they opened, and a write that is broken off changes nothing."""
    VersionedTable(df.sparkSession, path).replace(df)
    return path


def export_all(
    reports: Mapping[str, DataFrame], folder: str, single_file: bool = False
) -> dict[str, str]:
    """Each report to its own CSV folder below ``folder``."""
    return {name: export_csv(df, f"{folder}/{name}", single_file) for name, df in reports.items()}
