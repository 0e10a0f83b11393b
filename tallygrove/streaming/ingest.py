"""Ingest of many CSV chunks, as a batch or incrementally."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from operator import xor
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallygrove.schema import MONTH_PARTITION, SALES_SCHEMA
from tallygrove.session import brief_shuffles
from tallygrove.sources.files import CSV_OPTIONS, read_csv, strict_options
from tallygrove.sources.sinks import partition_value, sales_table, write_partitioned
from tallygrove.sources.storage import Folder
from tallygrove.sources.versions import CHUNK, CHUNK_ID


def ingest_chunks(
    spark: SparkSession,
    folder: str,
    dst: str,
    schema: StructType | str = SALES_SCHEMA,
    multi_line: bool = True,
) -> str:
    """All chunks of a folder as one table, laid out by month like the stored
    sales. A row that does not fit the schema fails the job."""
    return write_partitioned(read_csv(spark, folder, schema, multi_line), dst, MONTH_PARTITION)


def ingest_new_chunks(
    spark: SparkSession,
    folder: str,
    dst: str,
    checkpoint: str,
    schema: StructType | str = SALES_SCHEMA,
    max_files: int = 1000,
    multi_line: bool = True,
) -> str:
    """Add the chunks that arrived since the last run, then stop. The table is laid out
    by month. A row that does not fit the schema fails the run, which then has
    added nothing of its batch.

    The stream's checkpoint remembers which files were read and which output is
    committed, so a rerun adds nothing and a crashed run neither loses nor
    doubles rows. Both folders must be reachable by the whole cluster.
    """
    chunks = (
        spark.readStream.options(**CSV_OPTIONS)
        .options(**strict_options())
        .option("maxFilesPerTrigger", max_files)
        .option("multiLine", multi_line)
        .schema(schema)
        .csv(folder)
        .withColumn(MONTH_PARTITION, partition_value(MONTH_PARTITION))
    )
    query = (
        chunks.writeStream.format("parquet")
        .partitionBy(MONTH_PARTITION)
        .option("path", dst)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return dst


def ingested(spark: SparkSession, dst: str, schema: StructType = SALES_SCHEMA) -> DataFrame:
    """The rows ingested so far, in the order of the schema's columns."""
    return spark.read.parquet(dst).select(schema.fieldNames())


# A file's chunk: its name without the ending and without a revision such as _v2 or -rev3.
_REVISION = r"(?:[_.-](?:v|rev|r)\d+)?(?:\.[A-Za-z0-9]+)*$"
_FILE, _TIME = "_source_file", "_source_time"


def chunk_of(path: str) -> str:
    """``.../sales_0007_v2.csv`` -> ``sales_0007``."""
    name = unquote(path.rstrip("/").rsplit("/", 1)[-1])
    chunk = re.sub(_REVISION, "", name, count=1)
    return chunk if re.fullmatch(CHUNK_ID, chunk) else "c" + re.sub(r"[^A-Za-z0-9_.-]", "_", chunk)


def ingest_deliveries(
    spark: SparkSession,
    folder: str,
    dst: str,
    checkpoint: str,
    schema: StructType | str = SALES_SCHEMA,
    chunk_id: Callable[[str], str] = chunk_of,
    max_files: int = 1000,
    multi_line: bool = True,
) -> str:
    """Add or correct the chunks delivered since the last run, then stop. A file, or a folder of
    files, is one delivery of a chunk; its name tells which (``chunk_id``). A folder is put in place whole, by
    a rename; its files are read by as many tasks, so large chunks come as folders.

    The table (kept in versions, see :mod:`tallygrove.sources.versions`) has a ledger of its
    chunks: the file each came from, and a digest of its rows. A delivery that repeats what the ledger
    has, under whatever name, adds nothing; one with other rows replaces the chunk's rows, wherever
    they lie. Of several deliveries of a chunk in one batch the newest file counts, then the
    last name. Rows, ledger and the number of the stream's batch are published together: a
    batch that crashed is either all there, and not done again, or not there at all.

    A file without rows delivers nothing. A row that does not fit the schema fails the run.
    """
    files = (
        spark.readStream.options(**CSV_OPTIONS).options(**strict_options()).option("maxFilesPerTrigger", max_files)
        .option("multiLine", multi_line).option("recursiveFileLookup", True).schema(schema).csv(folder)
        .withColumns(_source())
    )

    def more(session: SparkSession, names: list[str]) -> DataFrame:
        return read_csv(session, names, schema, multi_line).withColumns(_source())

    def deliver(batch: DataFrame, number: int) -> None:
        stream = json.loads(Folder(spark, checkpoint).read("metadata"))["id"]
        put_batch(batch, dst, chunk_id, (stream, number), folder, more)

    query = files.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return dst


def _source() -> dict:
    return {_FILE: F.col("_metadata.file_path"), _TIME: F.col("_metadata.file_modification_time")}


def _delivery(path: str, inbox: str) -> tuple[str, bool]:
    """Where the delivery lies that a file belongs to, and whether that is a folder."""
    inside = unquote(urlsplit(path).path)
    below = inside.removeprefix(f"{inbox}/").count("/") if inbox and inside.startswith(f"{inbox}/") else 0
    return path.rsplit("/", below)[0], below > 0


def row_digest(columns: list[str]):
    """What makes a digest of a set of rows, whatever their order: their number, and sum and exclusive or of
    two hashes of each."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    return [F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(two).alias("x")]


def _digest(rows: list) -> str:
    """The digest of rows dealt over files."""
    return f"{sum(r['n'] for r in rows)}:{sum(int(r['s']) for r in rows)}:{reduce(xor, (r['x'] for r in rows))}"


def put_batch(
    batch: DataFrame, dst: str, chunk_id: Callable[[str], str], stream: tuple[str, int],
    folder: str = "", more: Callable[[SparkSession, list[str]], DataFrame] | None = None,
) -> list[str]:
    """Publish one batch of deliveries: the chunks that were added or replaced. The driver holds one
    line per file, of which a batch has a bounded number, and a delivery too. Files that a delivered folder has
    beside those of the batch are read by ``more``: a folder counts as a whole, in whatever batches its files come."""
    spark = batch.sparkSession
    table = sales_table(spark, dst)
    head = table.head()
    if head.streams.get(stream[0], -1) >= stream[1]:
        return []
    own = [c for c in batch.columns if c not in (_FILE, _TIME)]
    inbox = Folder(spark, folder).local_path() if folder else ""

    def digests(rows: DataFrame) -> list:
        with brief_shuffles(spark):
            return rows.groupBy(_FILE, _TIME).agg(*row_digest(own)).collect()

    seen = digests(batch)
    folders = {place for place, is_folder in (_delivery(r[_FILE], inbox) for r in seen) if is_folder}
    here = {unquote(r[_FILE]) for r in seen}
    listed = [f"{unquote(p)}/{n}" for p in sorted(folders) for n in Folder(spark, unquote(p)).names() if n[0] not in "_."]
    beside = [name for name in listed if name not in here] if more else []
    if beside:
        extra = more(spark, beside).select(batch.columns)
        seen, batch = seen + digests(extra), batch.unionByName(extra)
    deliveries: dict[str, list] = {}
    for r in seen:
        deliveries.setdefault(_delivery(r[_FILE], inbox)[0], []).append(r)
    known = {entry["digest"]: chunk for chunk, entry in head.ledger.items() if entry}
    last = {}
    for place, parts in sorted(deliveries.items(), key=lambda d: (max(r[_TIME] for r in d[1]), d[0])):
        last[chunk_id(place)] = place
    taken, ledger = [], {}
    for chunk, place in last.items():
        digest = _digest(deliveries[place])
        if known.setdefault(digest, chunk) == chunk and head.ledger.get(chunk, {}).get("digest") != digest:
            ledger[chunk] = {"digest": digest, "file": place}
            taken += [(r[_FILE], chunk) for r in deliveries[place]]
    if taken:
        named = F.broadcast(spark.createDataFrame(taken, f"{_FILE} string, {CHUNK} string"))
        rows = batch.join(named, _FILE).select(*own, CHUNK)
        table.put_chunks(rows, ledger, f"deliver {len(ledger)} chunks", stream)
    return sorted(ledger)
