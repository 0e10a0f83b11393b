"""Token ids in Huffman-coded files.

``write`` encodes the texts, counts every id over the whole collection, derives
canonical code lengths of at most ``MAX_BITS`` (package-merge), and writes blocks
of whole documents in ascending doc_id order. A block holds its bits and the bit offset of
every ``STRIDE``-th id. ``read`` decodes each block on its own: all stretches
between two offsets advance together, one table look-up per id.

Texts are dealt by ranges of doc_id and sorted once, before they are encoded; from there on every step
reads files in their order and moves nothing.

Layout below the folder: ``ids`` (as encoded, and what each task counted), ``codebook`` (id, bits),
``blocks`` (the files; their order is that of part and start), ``parts`` (ids before each part). A part is
what one task encoded.

Null texts count as empty and give the end id alone. Null ids sort first;
repeated ids are kept, ordered by content. An empty table gives empty
folders. Other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import scratch, texts
from tallygrove.llm.encoding import encoded_flat, encoder, forget

MAX_BITS = 18
STRIDE = 64
BLOCK_IDS = 1 << 16
END_ID = 2
REMEMBERED = 1_200_000  # chunks: some 240 MB a worker, while it encodes
BYTES_AT_ONCE = 8 << 20

BLOCK_SCHEMA = (
    "part int, start long, doc_ids array<bigint>, n_ids array<bigint>, offsets array<int>, bits binary"
)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits per symbol of an optimal prefix code with at most ``max_bits``
    (package-merge); 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    levels, row = [], weight
    for _ in range(max_bits - 1):
        packs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, packs])
        place = np.argsort(merged, kind="stable")
        levels.append(place >= n)  # True where the entry is a pack
        row = merged[place]
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_pack in reversed(levels):
        packs = int(is_pack[:take].sum())
        bits[: take - packs] += 1
        take = 2 * packs
    bits[:take] += 1
    out[order] = bits
    return out


class Codebook:
    """Canonical codes: shorter first, then by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.max_bits = int(self.lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        width = 1 << (self.max_bits - self.lengths[order])
        first = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.max_bits - self.lengths[order])).astype(np.uint64)
        self.both = self.codes << np.uint64(8) | lengths.astype(np.uint64)  # code and, below it, its bits
        # Per window of max_bits: the symbol, and above it the bits it takes.
        self.table = np.full(1 << self.max_bits, 1 << 24, np.uint32)
        self.table[: width.sum()] = np.repeat(order | self.lengths[order] << 24, width)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits, and the bit offset of every STRIDE-th id."""
        both = self.both[ids]
        n = (both & np.uint64(255)).view(np.int64)
        end = np.cumsum(n)
        begin = end - n
        both >>= np.uint64(8)
        both <<= (64 - (begin & 31) - n).view(np.uint64)
        word = begin >> 5
        first = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
        high = np.add.reduceat(both >> np.uint64(32), first)
        low = np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
        out = np.zeros(len(first) + 1, np.uint64)
        out[:-1] += high
        out[1:] += low
        return out.astype(">u4").tobytes(), begin[::STRIDE].astype(np.int32)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(bits + b"\0" * 8, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at, last = offsets.astype(np.int64), len(pairs) - 1
        out = np.empty((STRIDE, len(at)), np.uint32)
        keep, spare = (1 << self.max_bits) - 1, 64 - self.max_bits
        for k in range(STRIDE):
            # Stretches that are past the end read padding.
            window = pairs[np.minimum(at >> 5, last)] >> (spare - (at & 31)).astype(np.uint64)
            entry = self.table[window.astype(np.int64) & keep]
            out[k] = entry
            at += entry >> 24
        return (out.T & np.uint32(0xFFFFFF)).reshape(-1)[:n]


_IDS_SCHEMA = "part int, doc_id bigint, start bigint, ids binary, counted array<int>, n array<bigint>"


def _ids_table(df: DataFrame, tokenizer_path: str, end_id: int, size: int) -> DataFrame:
    """Ids in ascending order of doc_id, dealt into parts by ranges; ``start`` counts the ids before a
    document in its part. Behind the rows of each part one row tells how often each id was written
    (``counted``, ``n``) and, as its start, how many ids there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, dtype = TaskContext.get().partitionId(), encoder(tokenizer_path, REMEMBERED).dtype
        total, at = np.zeros(size, np.int64), 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["part", "doc_id", "start", "ids", "counted", "n"]

        for doc_ids, flat, lengths in encoded_flat(batches, tokenizer_path, end_id, REMEMBERED, BYTES_AT_ONCE):
            total += np.bincount(flat, minlength=size)
            ends, n = np.cumsum(lengths), len(lengths)
            places = np.concatenate(([0], ends * dtype.itemsize)).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), pa.py_buffer(flat)])
            nulls = [pa.nulls(n, t) for t in types[4:]]
            columns = [np.full(n, part, np.int32), doc_ids, at + ends - lengths, data, *nulls]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)
            at += int(ends[-1])
        if at:
            used = np.flatnonzero(total)
            row = [[part], [None], [at], [None], [used], [total[used]]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(row, types)], names=names)

    # Texts are moved, not ids: they are as long, and pack better.
    order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc(), F.col("text").asc()]
    rows = texts(df).withColumn("key", F.xxhash64("text"))
    return rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, _IDS_SCHEMA)


def _counts(ids: DataFrame, n: int) -> np.ndarray:
    """How often each id occurs; one row per id and task is shuffled."""
    each = ids.filter("counted IS NOT NULL").select(F.inline(F.arrays_zip(F.col("counted").alias("id"), F.col("n"))))
    out = np.zeros(n, np.int64)
    for r in each.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row per id of the vocabulary
        out[r["id"]] = r["n"]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], book: Codebook, dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive documents of a part. ``start`` counts ids within the part."""
    schema = pa.schema(
        [("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
         ("n_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("bits", pa.binary())]
    )
    docs, held, count, start, part = [], [], 0, 0, None
    forget()

    def close() -> pa.RecordBatch:
        bits, offsets = book.encode(np.concatenate(held))
        row = [[part], [start], [docs], [[len(x) for x in held]], [offsets], [bits]]
        return pa.record_batch([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    for b in batches:
        for p, doc_id, at, x in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "start")), b.column("ids")):
            if docs and (p != part or count >= BLOCK_IDS):
                yield close()
                docs, held, count = [], [], 0
            if not docs:
                part, start = p, at
            docs.append(doc_id)
            held.append(np.frombuffer(x.as_buffer(), dtype))
            count += len(held[-1])
    if docs:
        yield close()


def write(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, max_bits: int = MAX_BITS) -> str:
    """Encode all texts into files below ``folder`` (which every executor must reach)."""
    spark = df.sparkSession
    dtype, vocabulary = encoder(tokenizer_path).dtype, encoder(tokenizer_path).tok.get_vocab_size()
    size = max(vocabulary, end_id + 1)
    _ids_table(df, tokenizer_path, end_id, size).write.option("compression", "lz4_raw").parquet(f"{folder}/ids")
    ids = spark.read.schema(_IDS_SCHEMA).parquet(f"{folder}/ids")
    lengths = code_lengths(_counts(ids, size), max_bits)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id bigint, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    rows = ids.filter("counted IS NULL").select("part", "doc_id", "start", "ids")
    blocks = rows.mapInArrow(lambda it: _blocks(it, Codebook(lengths), dtype), BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    sizes = ids.filter("counted IS NOT NULL").select("part", F.col("start").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before"))
    parts.write.parquet(f"{folder}/parts")
    return folder


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Decoded documents: doc_id, ``start`` (ids before it), ``n_tokens``,
    ``ids_crc32`` and, if wanted, the ids."""
    rows = spark.read.parquet(f"{folder}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        for b in batches:
            for part, start, docs, sizes, offsets, bits in zip(
                *[b.column(c) for c in ("part", "start", "doc_ids", "n_ids", "offsets", "bits")]
            ):
                n = np.array(sizes.as_py(), np.int64)
                ids = book.decode(bits.as_py(), offsets.values.to_numpy(), int(n.sum())).astype("<u4")
                ends = np.cumsum(n)
                each = np.split(ids, ends[:-1])
                out = {
                    "part": pa.array([part.as_py()] * len(n), pa.int32()),
                    "doc_id": docs.values,
                    "start": pa.array(start.as_py() + ends - n, pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                yield pa.record_batch(out)

    fields = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    fields += ", ids array<bigint>" if with_ids else ""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks").mapInArrow(run, fields)
    parts = spark.read.schema("part int, ids_before bigint").parquet(f"{folder}/parts")
    joined = blocks.join(F.broadcast(parts), "part")  # one row per part
    return joined.withColumn("start", F.col("start") + F.col("ids_before")).drop("part", "ids_before")


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write to a new shared folder and read back."""
    spark = df.sparkSession
    return read(spark, write(df, scratch(spark, "tokens"), tokenizer_path, end_id), with_ids=False)
