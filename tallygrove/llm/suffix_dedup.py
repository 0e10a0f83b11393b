"""Repeated substrings by a distributed merge sort of suffixes.

Every string of ``length`` bytes that starts at two places or more is removed at all of
them. To sort all suffixes would move each byte ``length`` times; most cannot be part
of a repeat, and that shows without sorting: in each window of ``length`` bytes the gram with the
least hash is its anchor, so equal windows have equal anchors in the same place. Only suffixes at
anchors that occur twice are sorted, with the bytes that their windows reach.

1. Anchors of every document are counted by hash.
2. Each task sorts the suffixes at its repeated anchors and writes them front-coded:
   the number of bytes shared with the suffix before, and the rest. Equal suffixes of a
   task become one entry with its places. Runs are dealt by anchor.
3. A loser tree merges the runs of a bucket. It keeps for every run the prefix
   its suffix shares with the last one put out; of two suffixes the one that shares more
   comes first, and only where both share the same are bytes compared, from there on.
4. In the merged order suffixes with the same anchor are neighbours. Two windows with
   the anchor at offset i are equal if ``length - i`` bytes to the right and i bytes to
   the left agree, which the shared prefixes of both sides tell for all i.

Equal documents are recognised first, by SHA-256: they are repeats of each other as a whole, and one
of them stands for all in the sort. Anchors are found by a hash, which only chooses what is compared:
whether two strings are equal is decided by their bytes.

A bucket gets a task's equal suffixes as one entry with their number; the places stay with the task that
found them, and take the result back from there. So a passage that is in every document is one entry
per task. An anchor with more than ``HOT`` places, which may stand in as many different surroundings, is
dealt over many buckets: windows whose part behind the anchor's start is ``a`` to ``a + STEP - 1`` bytes
long share the first ``a`` of them and, before the anchor, all but the last ``STEP - 1`` bytes that they can reach.
These bytes make their key, for each ``a``, and windows of one key are merged like any others.

The texts are moved once, into a table dealt by document; lists of anchors and spans come to them.

Null texts count as empty. Repeated rows are documents of their own (and
repeats of each other), rows may lack an id. Texts shorter than ``length`` lose nothing.
An empty table gives no rows. Columns other than id and text are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import bucketed, cut, texts, unique_ids

LENGTH = 200
GRAM = 32
BUCKET_PLACES = 40_000  # anchor places merged in one task, about
HOT = 50_000  # places of an anchor that are merged in one bucket
STEP = 16
RUN_BYTES = 48 << 20  # a task starts a new run beyond this
SMALL_GROUP = 10  # suffixes of one anchor compared in pairs

_SEGMENT = 1 << 22  # window starts looked at in one go
_PLACE = np.uint64((1 << 24) - 1)

# Entries of a run for one bucket, and in rows of their own (without a bucket) the places of a run's entries.
RUN_SCHEMA = (
    "run bigint, bucket int, entry array<int>, shared array<int>, sizes array<int>, tails binary, left_sizes array<int>, "
    "lefts binary, n array<int>, rows array<bigint>, starts array<bigint>"
)
FOUND_SCHEMA = "run bigint, entry int, low int, high int"
SPAN_SCHEMA = "row_key bigint, start bigint, stop bigint"


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of each anchor; the windows of all
    anchors together are all windows. Of equal hashes the leftmost counts."""
    windows, wide = len(data) - length + 1, length - gram + 1
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(windows, 0), _SEGMENT):
        n = min(_SEGMENT, windows - at)
        piece = data[at : at + n + length - 1]
        words = np.ndarray((len(piece) - 7,), "<u8", piece, strides=(1,))
        grams = len(piece) - gram + 1
        h = np.zeros(grams, np.uint64)
        for k in range(0, gram, 8):
            h = (h + words[k : k + grams]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        key = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        pad = np.full(-grams % wide, np.uint64(0xFFFFFFFFFFFFFFFF))
        block = np.concatenate([key, pad]).reshape(-1, wide)
        before = np.minimum.accumulate(block, axis=1).reshape(-1)
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        place = (np.minimum(behind[:n], before[wide - 1 : wide - 1 + n]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        parts.append((place[first] + at, first + at, last + at, h[place[first]].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at : at + 64], b[at : at + 64]
        if x != y:
            m = min(len(x), len(y))
            differ = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return at + m - (differ.bit_length() + 7) // 8
        at += 64
    return n


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix with the string before, and the rest of each sorted string."""
    shared, tails, last = [], [], b""
    for s in strings:
        n = common(last, s, 0)
        shared.append(n)
        tails.append(s[n:])
        last = s
    return shared, tails


def decoded(shared: list[int], sizes: list[int], tails: bytes) -> Iterator[tuple[bytes, int]]:
    last, at = b"", 0
    for n, size in zip(shared, sizes):
        last = last[:n] + tails[at : at + size]
        at += size
        yield last, n


def merge(runs: list[Iterable[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merge sorted front-coded runs: (string, prefix shared with the string before, run)."""
    streams = [iter(r) for r in runs]
    size = 1 << max(len(streams) - 1, 0).bit_length()
    now: list[bytes | None] = [next(s, (None, 0))[0] for s in streams] + [None] * (size - len(streams))
    shared = [0] * size  # with the string put out last
    loser = [0] * size

    def first(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if x is None:
            return b, a
        if y is None or shared[a] > shared[b]:
            return a, b
        if shared[a] < shared[b]:
            return b, a
        n = common(x, y, shared[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    best = list(range(size))
    while len(best) > 1:  # fill the tree from the leaves up
        half = len(best) // 2
        for k in range(half):
            best[k], loser[half + k] = first(best[2 * k], best[2 * k + 1])
        del best[half:]
    top = best[0] if best else 0
    while now and now[top] is not None:
        yield now[top], shared[top], top
        now[top], shared[top] = next(streams[top], (None, 0))
        node = (size + top) // 2
        while node:
            top, loser[node] = first(top, loser[node])
            node //= 2


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each stretch of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def repeated_offsets(
    rights: list[bytes], lefts: list[bytes], n: list[int], shared: list[int], length: int = LENGTH
) -> list[list[tuple[int, int]]]:
    """Suffixes of one anchor in sorted order: bytes from it on, bytes before it (backwards), places, and the prefix
    shared with the suffix before. Per suffix the stretches of offsets whose windows are repeated."""
    out: list[list[tuple[int, int]]] = []
    size = len(rights)
    low = [length - len(r) for r in rights]
    if size <= SMALL_GROUP:
        whole = [k > 1 for k in n]
        found = [[(low[e], len(lefts[e]))] if whole[e] and low[e] <= len(lefts[e]) else [] for e in range(size)]
        for e in range(size):
            right = len(rights[e])
            for f in range(e + 1, size):
                right = min(right, shared[f])
                if right + min(len(lefts[e]), len(lefts[f])) < length:
                    continue
                left = common(lefts[e], lefts[f], 0)
                if left + right >= length:
                    found[e].append((length - right, left))
                    found[f].append((length - right, left))
        return [_joined(x) for x in found]
    order = sorted(range(size), key=lefts.__getitem__)
    left_shared = np.zeros(size, np.int64)
    for k in range(1, size):
        left_shared[k] = common(lefts[order[k - 1]], lefts[order[k]], 0)
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    right_shared, weight = np.array(shared, np.int64), np.array(n, np.int64)
    right_shared[0] = 0
    low_at, high_at = np.array(low), np.array([len(x) for x in lefts])
    flags = np.zeros((length, size), bool)
    for i in range(int(low_at.min()), int(high_at.max()) + 1):
        inside = np.flatnonzero((low_at <= i) & (i <= high_at))
        if len(inside):
            right_class = np.cumsum(right_shared < length - i)[inside]
            left_class = np.cumsum(left_shared < i)[rank[inside]]
            _, inverse = np.unique(right_class * (size + 1) + left_class, return_inverse=True)
            flags[i, inside] = np.bincount(inverse, weight[inside])[inverse] > 1
    for e in range(size):
        out.append(_spans(flags[:, e]))
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, row_key, whole, rest, n): distinct anchors of each document; ``whole`` and ``rest`` are 128 bits of
    the SHA-256 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got: list[list[np.ndarray]] = [[], [], [], [], []]
                for key, text in zip(part.column("row_key").to_pylist(), part.column("text").to_pylist()):
                    data = text.encode()
                    h, n = np.unique(anchors(data, length, gram)[3], return_counts=True)
                    sha = np.frombuffer(hashlib.sha256(data).digest(), "<i8") if len(h) else (0, 0)
                    same = [np.full(len(h), x, np.int64) for x in (key, sha[0], sha[1])]
                    for to, x in zip(got, (h, *same, n)):
                        to.append(x)
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in got], names=["hash", "row_key", "whole", "rest", "n"])

    schema = "hash bigint, row_key bigint, whole bigint, rest bigint, n bigint"
    return docs.select("row_key", "text").mapInArrow(run, schema)


def _dealt(data: bytes, h: int, place: int, first: int, last: int, length: int, gram: int) -> Iterator[tuple[bytes, int, int]]:
    """(key, first window, last window) of a common anchor's windows, by the length of their part behind
    the anchor's start."""
    for a in range(gram, length + 1, STEP):
        before = max(length - a - STEP + 1, 0)  # bytes before the anchor that all of these windows reach
        low, high = max(first, place - (length - a)), min(last, place - before)
        if low <= high:
            surroundings = data[place - before : place + a]
            yield xxhash.xxh64_digest(surroundings, h % 2**32 + a), low, high


class _Run:
    """Entries of one task: suffix and left side -> places."""

    def __init__(self, number: int):
        self.number = number
        self.entries: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        self.bytes = 0

    def add(self, group: bytes, data: bytes, place: int, first: int, last: int, key: int, length: int) -> None:
        entry = (group + data[place : last + length], data[first:place][::-1])
        places = self.entries.get(entry)
        if places is None:
            self.entries[entry] = [(key, place)]
            self.bytes += len(entry[0]) + len(entry[1]) + 200
        else:
            places.append((key, place))
            self.bytes += 100

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[int, tuple[bytes, bytes]]]] = {}
        ordered = sorted(self.entries)
        for number, entry in enumerate(ordered):
            by.setdefault(_bucket_of(entry[0], buckets), []).append((number, entry))
        packed = zstandard.ZstdCompressor(level=3).compress
        for bucket, entries in by.items():
            shared, tails = front_coded([s for _, (s, _) in entries])
            lefts = [x for _, (_, x) in entries]
            yield _run_row(
                run=self.number, bucket=bucket, entry=[k for k, _ in entries], shared=shared, sizes=[len(t) for t in tails],
                tails=packed(b"".join(tails)), left_sizes=[len(x) for x in lefts], lefts=packed(b"".join(lefts)),
                n=[min(len(self.entries[e]), 2) for _, e in entries],
            )
        if ordered:
            places = [self.entries[e] for e in ordered]
            yield _run_row(
                run=self.number, n=[len(p) for p in places], rows=[k for p in places for k, _ in p], starts=[s for p in places for _, s in p]
            )


def _run_row(**values) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in RUN_SCHEMA.split(", ")]
    return pa.record_batch([pa.array([values.get(name)], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _bucket_of(suffix: bytes, buckets: int) -> int:
    return (int.from_bytes(suffix[:8]) * 0x9E3779B97F4A7C15 >> 32) % (1 << 32) * buckets >> 32


def runs(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Front-coded sorted runs of (row_key, text, hashes, hot), per task and bucket, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, made = TaskContext.get().partitionId() << 24, 0
        held = _Run(part_id)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                columns = part.column("row_key").to_pylist(), part.column("text").to_pylist(), part.column("hashes"), part.column("hot")
                for key, text, hashes, hot in zip(*columns):
                    data = text.encode()
                    place, first, last, h = anchors(data, length, gram)
                    some = np.flatnonzero(np.isin(h, hashes.values.to_numpy()))
                    for p, a, z, x in zip(*(v[some].tolist() for v in (place, first, last, h))):
                        held.add(x.to_bytes(8, signed=True), data, p, a, z, key, length)
                    some = np.flatnonzero(np.isin(h, hot.values.to_numpy())) if len(hot.values) else ()
                    for p, a, z, x in zip(*(v[some].tolist() for v in (place, first, last, h))) if len(some) else ():
                        for group, low, high in _dealt(data, x, p, a, z, length, gram):
                            held.add(group, data, p, low, high, key, length)
                if held.bytes > RUN_BYTES:
                    yield from held.rows(buckets)
                    made += 1
                    held = _Run(part_id + made)
        yield from held.rows(buckets)

    return docs.select("row_key", "text", "hashes", "hot").mapInArrow(run, RUN_SCHEMA)


def _merge_bucket(table: pa.Table, length: int) -> pa.Table:
    """Merge the runs of a bucket: (run, entry, low, high), the offsets of an entry's repeated windows."""
    streams, lefts, counts, names = [], [], [], []
    unpacked = zstandard.ZstdDecompressor().decompress
    for row in table.to_pylist():
        streams.append(decoded(row["shared"], row["sizes"], unpacked(row["tails"])))
        row["lefts"] = unpacked(row["lefts"])
        ends = np.cumsum(row["left_sizes"]).tolist()
        lefts.append([row["lefts"][e - s : e] for e, s in zip(ends, row["left_sizes"])])
        counts.append(row["n"])
        names.append([(row["run"], k) for k in row["entry"]])
    at = [0] * len(streams)
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple[bytes, bytes, int, int, tuple[int, int]]] = []

    def close() -> None:
        if len(group) == 1 and group[0][2] < 2:
            return
        rights, left, n, shared, whose = (list(x) for x in zip(*group))
        for spans, name in zip(repeated_offsets(rights, left, n, shared, length), whose):
            out.extend((*name, low, high) for low, high in spans)

    for string, shared, k in merge(streams):
        j = at[k]
        at[k] += 1
        if shared < 8 and group:
            close()
            group.clear()
        group.append((string[8:], lefts[k][j], counts[k][j], max(shared - 8, 0), names[k][j]))
    if group:
        close()
    columns = list(zip(*out)) or [()] * 4
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["run", "entry", "low", "high"])


def _placed(places: pa.Table, found: pa.Table, length: int) -> pa.Table:
    """(row_key, start, stop) of the repeated windows of one run's entries."""
    out = [np.zeros(0, np.int64)] * 3
    if places.num_rows and found.num_rows:
        (row,) = places.to_pylist()
        n, keys, starts = (np.array(row[c], np.int64) for c in ("n", "rows", "starts"))
        entry, low, high = (found.column(c).to_numpy().astype(np.int64) for c in ("entry", "low", "high"))
        count, first = n[entry], (np.cumsum(n) - n)[entry]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out = [keys[at], starts[at] - np.repeat(high, count), starts[at] - np.repeat(low, count) + length]
    return pa.table(dict(zip(("row_key", "start", "stop"), map(pa.array, out))))


def repeated_spans(docs: DataFrame, keys: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(row_key, start, stop) of repeated bytes of (row_key, text), in pieces that may
    overlap. Of equal texts (by ``keys``: row_key, sha) only the one with the smallest key is looked at, beside
    other texts. Lists that grow with the corpus are never broadcast, whatever their size."""
    rows = cut(_anchor_rows(docs, length, gram), "anchors")
    sides = [f(c).alias(f"{f.__name__}_{c}") for c in ("whole", "rest") for f in (F.min, F.max)]
    counts = rows.groupBy("hash").agg(*sides, F.max("n").alias("inside"), F.sum("n").alias("n"))
    twice = "min_whole <> max_whole OR min_rest <> max_rest OR inside > 1"
    repeated = cut(counts.filter(twice).select("hash", "n"), "repeated")
    roles = -(-(length - gram + 1) // STEP)
    total = repeated.agg(F.sum(F.when(F.col("n") > hot, F.col("n") * roles).otherwise(F.col("n")))).first()[0] or 0
    # Reduced by document in each task first, so that no common anchor is one group.
    chosen = cut(keys.groupBy("sha").agg(F.min("row_key").alias("row_key")).select("row_key"), "first-copies")
    mine = rows.select("hash", "row_key").join(repeated.hint("merge"), "hash")
    lists = mine.groupBy("row_key").agg(
        F.collect_list(F.when(F.col("n") <= hot, F.col("hash"))).alias("hashes"),
        F.collect_list(F.when(F.col("n") > hot, F.col("hash"))).alias("hot"),
    )
    lists = cut(lists.join(chosen.hint("merge"), "row_key"), "lists")
    buckets = max(1, -(-total // BUCKET_PLACES))
    sorted_runs = cut(runs(docs.join(lists.hint("merge"), "row_key"), buckets, length, gram), "runs")
    found = sorted_runs.filter("bucket IS NOT NULL").groupBy("bucket").applyInArrow(lambda table: _merge_bucket(table, length), FOUND_SCHEMA)
    places = sorted_runs.filter("bucket IS NULL").select("run", "n", "rows", "starts")
    return places.groupBy("run").cogroup(found.groupBy("run")).applyInArrow(lambda a, b: _placed(a, b, length), SPAN_SCHEMA)


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, ``spans`` (maximal removed runs) and ``kept`` (the remaining bytes) of every row."""
    docs = bucketed(unique_ids(texts(df)).select("row_key", "doc_id", "text"), "row_key", "texts")
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    keys = cut(docs.select("row_key", sha.alias("sha"), F.octet_length("text").alias("n_bytes")), "keys")
    copies = cut(keys.groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1").select("sha"), "copied")
    whole = keys.filter(F.col("n_bytes") >= length).join(copies.hint("merge"), "sha").select("row_key", F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").cast("bigint").alias("stop"))
    spans = repeated_spans(docs.select("row_key", "text"), keys.select("row_key", "sha"), length, gram, hot).unionByName(whole)
    by_doc = cut(spans.groupBy("row_key").agg(F.collect_list(F.struct("start", "stop")).alias("pieces")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: dict[str, list] = {"n_bytes": [], "spans": [], "kept": []}
                for text, pieces in zip(part.column("text").to_pylist(), part.column("pieces").to_pylist()):
                    data, runs_ = text.encode(), []
                    for s, e in sorted((p["start"], p["stop"]) for p in pieces or ()):
                        if runs_ and s <= runs_[-1][1]:
                            runs_[-1][1] = max(e, runs_[-1][1])
                        else:
                            runs_.append([s, e])
                    edges = [0, *[x for r in runs_ for x in r], len(data)]
                    out["n_bytes"].append(len(data))
                    out["spans"].append([{"start": s, "stop": e} for s, e in runs_])
                    out["kept"].append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                        "spans": pa.array(out["spans"], kind),
                        "kept": pa.array(out["kept"], pa.binary()),
                    }
                )

    joined = docs.join(by_doc.hint("merge"), "row_key", "left").select("doc_id", "text", "pieces")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")

