"""Best-fit packing planned on the histogram of lengths.

Documents longer than a sequence are cut into full pieces and a rest; nothing
else is cut. Best-fit decreasing runs over the counts per length: all bins with
the same room left are one group, so planning costs as much for a billion
pieces as for a thousand. The plan is a list of runs (length, ranks, sequences,
offset); a piece takes the slot of its rank among the pieces of its length. Ranks
come from counts per (length, bucket), so a very common length is no single group.

A null text is empty and gives its end id alone. Repeated rows and ids are packed
like others; null ids too. An empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, texts
from tallygrove.llm.encoding import encoded_flat

SEQUENCE = 2048
END_ID = 0
BUCKET_ROWS = 1_000  # rows of one length that are ranked together

RUNS = "length int, runs array<struct<first_rank:bigint,n:bigint,per_bin:bigint,first_bin:bigint,offset:int>>"


def pieces(df: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, flat, lengths in encoded_flat(batches, tokenizer_path, end_id):
            flat, stop = flat.astype("<u4"), 0
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, n in zip(doc_ids.to_pylist(), lengths.tolist()):
                first, stop = stop, stop + n
                for k, at in enumerate(range(first, stop, size)):
                    part = flat[at : min(at + size, stop)]
                    row = (doc_id, k, at - first, len(part), zlib.crc32(part), part.astype(np.int64) if with_ids else None)
                    for name, value in zip(out, row):
                        out[name].append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            arrays = {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds) if with_ids or n != "ids"}
            yield pa.record_batch(arrays)

    fields = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"
    return texts(df).mapInArrow(run, fields + (", ids array<bigint>" if with_ids else ""))


def plan(counts: dict[int, int], size: int = SEQUENCE) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Best-fit decreasing over counts. Per length its runs: (first rank, pieces,
    pieces per bin, first bin, offset in the bin)."""
    groups: dict[int, list[list[int]]] = {}  # room left -> [first bin, bins]
    rooms: list[int] = []  # sorted; small, at most one entry per size
    next_bin = 0
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}

    def leave(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                groups[room] = []
                heapq.heappush(rooms, room)
            groups[room].append([first, bins])

    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, out.setdefault(length, [])
        skipped = []
        while left:
            while rooms and (rooms[0] < length or not groups.get(rooms[0])):
                r = heapq.heappop(rooms)
                if groups.get(r):
                    skipped.append(r)
                else:
                    groups.pop(r, None)
            if rooms:
                room = rooms[0]
                first, bins = groups[room].pop()
            else:
                room, first = size, next_bin
                bins = -(-left // (size // length))
                next_bin += bins
            per = room // length
            whole = min(bins, left // per)
            if whole:
                runs.append((rank, whole * per, per, first, size - room))
                rank, left = rank + whole * per, left - whole * per
                leave(room - per * length, first, whole)
            if left and whole < bins:  # fewer are left than the next bin holds
                runs.append((rank, left, left, first + whole, size - room))
                leave(room - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            leave(room, first + whole, bins - whole)
        for r in skipped:
            heapq.heappush(rooms, r)
    return out


def _sums_before(sizes: DataFrame) -> DataFrame:
    """(length, bucket, before): the rows of a length in the buckets before. Running sums are taken in
    groups of BUCKET_ROWS buckets and over the groups, so that no task has all buckets of a common length."""
    group = F.floor(F.col("bucket") / BUCKET_ROWS)
    sizes = sizes.withColumn("group", group)
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("length", "group").agg(F.sum("n").alias("n"))
    over = upto.partitionBy("length").orderBy("group")
    groups = groups.select("length", "group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("n").over(upto.partitionBy("length", "group").orderBy("bucket")), F.lit(0))
    inside = sizes.select("length", "group", "bucket", within.alias("within"))
    return inside.join(groups, ["length", "group"]).select("length", "bucket", (F.col("first") + F.col("within")).alias("before"))


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Add ``rank``, from 0 within each length, without one task per length."""
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sizes = _sums_before(cut(sizes, "bucket-sizes"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    inside = rows.withColumn("inside", F.row_number().over(order))
    joined = inside.join(sizes, ["length", "bucket"])
    return joined.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("bucket", "before", "inside")


def place(rows: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, ids_crc32, ...).
    The rows are read three times: give stored ones."""
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = spark.createDataFrame([(k, v) for k, v in plan(histogram, size).items()], RUNS)
    joined = ranked(rows, histogram).join(F.broadcast(planned), "length")  # one row per length, of at most ``size``
    hit = F.filter("runs", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") < r["first_rank"] + r["n"]))
    joined = joined.withColumn("run", F.element_at(hit, 1)).withColumn("k", F.col("rank") - F.col("run.first_rank"))
    return joined.withColumns(
        {
            "sequence_id": (F.col("run.first_bin") + F.floor(F.col("k") / F.col("run.per_bin"))).cast("bigint"),
            "offset": (F.col("run.offset") + F.pmod("k", F.col("run.per_bin")) * F.col("length")).cast("bigint"),
        }
    ).drop("runs", "run", "k", "rank")


def pack(df: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all texts with their places."""
    return place(cut(pieces(df, tokenizer_path, size, end_id, with_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ids in order and where each piece ends. A group holds
    one sequence."""
    row = F.struct("offset", "length", "doc_id", "piece", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("p"))
    ends = F.transform("p", lambda x: x["offset"] + x["length"])
    return grouped.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), ends.alias("ends"))
