"""SimHash near-duplicates with pivot distance tables.

Distinct fingerprints get a table of Hamming distances to fixed reference
fingerprints (pivots). Pairs that meet in a bucket are discarded where any
coordinate differs by more than the radius, since a distance to a pivot cannot
differ by more than the pair's own distance; survivors are verified bit by bit.
Buckets are cells of unit pivots: the distances to zero and to a single-bit
fingerprint tell that bit, so fixing some bits fixes a cell.

* ``exact_scheme``: the bits are cut in blocks, radius many of which may differ; every choice of
  the other blocks is a cell, so each pair within the radius meets.
* ``sampled_scheme``: for radii too wide for that; cells of random bits. A pair whose bits
  differ with share p meets with probability 1 - (1 - (1 - p)^bits)^cells.

Within a bucket a search from member to member leaves one link per member found, never all
pairs. Buckets above ``BUCKET`` distinct fingerprints are split once by further bits under the
exact scheme, which loses no pair; those still larger, and all large ones of the sampled
scheme, are compared in pairs of parts, so size never changes which pairs are found.
Fingerprints are distinct, so copies of a text, however many, are one member.

Null and empty texts have fingerprint zero and are linked like others. Rows with repeated ids
are rows of their own; a row without id takes part, a group without any id has none. An
empty table gives no rows. Columns other than id and text are not carried.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, texts, unique_ids
from tallygrove.llm.components import components

SEED = 42
N_PIVOTS = 24
BUCKET = 8192  # distinct fingerprints compared in one go
STARS = 16  # representatives of a larger bucket
SMALL = 16  # shingles under which a fingerprint tells little of a set


@dataclass(frozen=True)
class Scheme:
    """``cells``: bit places of each cell. ``finer``: per cell, the places that split a
    large bucket further; none where a split would part pairs within the radius."""

    bits: int
    radius: int
    cells: tuple[tuple[int, ...], ...]
    finer: tuple[tuple[tuple[int, ...], ...], ...]


def _blocks(places: Sequence[int], n: int) -> list[tuple[int, ...]]:
    return [tuple(int(x) for x in part) for part in np.array_split(np.array(places), n)]


def _choices(places: Sequence[int], n: int, radius: int) -> list[tuple[int, ...]]:
    """All ways to keep n - radius of n blocks."""
    return [sum(kept, ()) for kept in itertools.combinations(_blocks(places, n), n - radius)]


def exact_scheme(bits: int = 64, radius: int = 3, blocks: int = 6, finer_blocks: int = 8) -> Scheme:
    cells = _choices(range(bits), blocks, radius)
    finer = [_choices([b for b in range(bits) if b not in set(c)], finer_blocks, radius) for c in cells]
    return Scheme(bits, radius, tuple(cells), tuple(map(tuple, finer)))


def sampled_scheme(bits: int, radius: int, n_cells: int, cell_bits: int, seed: int = 7) -> Scheme:
    rng = np.random.default_rng(seed)
    cells = tuple(tuple(int(x) for x in rng.permutation(bits)[:cell_bits]) for _ in range(n_cells))
    return Scheme(bits, radius, cells, ((),) * n_cells)


def _pivots(bits: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 256, (N_PIVOTS, bits // 8), np.uint8)


def hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of words, lower case in ASCII; repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0] + [e + 1 for e in ends[:-shingle]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)


def fingerprint(h: np.ndarray, bits: int = 64) -> bytes:
    """One bit per place: set in over half of the hashes. Beyond 64 bits each hash is
    mixed further, once per 64."""
    out = b""
    for k in range(bits // 64):
        if k:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):
            part = np.ascontiguousarray(h[at : at + 4096]).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint16)  # 4096 rows at most
        out += np.packbits(2 * ones > len(h)).tobytes()
    return out


def fingerprints(df: DataFrame, shingle: int = 3, bits: int = 64) -> DataFrame:
    """row_key, doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fp = [fingerprint(hashes(t, shingle), bits) for t in part.column("text").to_pylist()]
                yield pa.record_batch({"row_key": part.column("row_key"), "doc_id": part.column("doc_id"), "fp": pa.array(fp, pa.binary())})

    rows = unique_ids(texts(df)).select("row_key", "doc_id", "text")
    return rows.mapInArrow(run, "row_key bigint, doc_id bigint, fp binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def pivot_table(nodes: DataFrame, bits: int) -> DataFrame:
    """(node, fp) with ``dist``: the distance to each pivot, one byte or two each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = _pivots(bits)
        for b in batches:
            fp = _matrix(b.column("fp"), bits // 8)
            dist = np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.uint16) for p in pivots], axis=1)
            yield pa.record_batch({"node": b.column("node"), "fp": b.column("fp"), "dist": pa.array([r.tobytes() for r in dist], pa.binary())})

    return nodes.select("node", "fp").mapInArrow(run, "node bigint, fp binary, dist binary")


def _cell_values(fp: np.ndarray, places: Sequence[int]) -> np.ndarray:
    ones = np.unpackbits(fp, axis=1)[:, list(places)].astype(np.int64)
    return ones @ (1 << np.arange(len(places), dtype=np.int64))


def cell_rows(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(cell, value, node): one row per node and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _matrix(b.column("fp"), scheme.bits // 8)
            for k, places in enumerate(scheme.cells):
                cell = pa.array(np.full(len(fp), k, np.int32))
                yield pa.record_batch({"cell": cell, "value": pa.array(_cell_values(fp, places)), "node": b.column("node")})

    return nodes.select("node", "fp").mapInArrow(run, "cell int, value bigint, node bigint")


def finer_rows(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows (cell, value, node, fp) of large buckets once more, by further bits. The new
    value is a hash of all that is fixed; an accidental meeting costs a comparison only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _matrix(b.column("fp"), scheme.bits // 8)
            cells, values, nodes = (b.column(c).to_numpy() for c in ("cell", "value", "node"))
            for k in np.unique(cells):
                at = cells == k
                for j, places in enumerate(scheme.finer[k]):
                    value = _cell_values(fp[at], places)
                    mixed = (values[at] * 1_000_003 + j) * 1_000_003 + value
                    yield pa.record_batch({"cell": pa.array(cells[at]), "value": pa.array(mixed), "node": pa.array(nodes[at])})

    return rows.mapInArrow(run, "cell int, value bigint, node bigint")


def search(node: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all members near each other, over any number of steps: each member
    found is compared with those not found yet. ``near(i, left)`` tells which of ``left`` are near i."""
    left = np.arange(len(node))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            found = np.flatnonzero(near(i, left))
            if len(found):
                out += [(int(node[i]), int(node[j])) for j in left[found]]
                queue += left[found].tolist()
                left = np.delete(left, found)
    return out


def _within(radius: int, bits: int):
    """Nearness of fingerprints: pivot distances discard, bits decide."""

    def build(m: pa.StructArray):
        fp = _matrix(m.field("fp"), bits // 8)
        dist = np.frombuffer(b"".join(m.field("dist").to_pylist()), np.uint16).reshape(len(fp), -1).astype(np.int16)
        words = np.ascontiguousarray(fp).view(np.uint64)

        def near(i: int, left: np.ndarray) -> np.ndarray:
            out = np.ones(len(left), bool)
            for p in range(0, dist.shape[1], 8):
                some = np.flatnonzero(out)
                gap = np.abs(dist[left[some], p : p + 8] - dist[i, p : p + 8]).max(axis=1)
                out[some[gap > radius]] = False
            some = np.flatnonzero(out)
            out[some] = np.bitwise_count(words[left[some]] ^ words[i]).sum(axis=1, dtype=np.int64) <= radius
            return out

        return near

    return build


def _group_links(groups: DataFrame, item: Sequence[str], build: Callable) -> DataFrame:
    """Links within each group of (cell, value, a, b). A member may be listed twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for members in b.column("members"):
                m = members.values
                node, at = np.unique(m.field("node").to_numpy(), return_index=True)
                if len(node) > 1:
                    found += search(node, build(m.take(pa.array(at))))
            x, y = zip(*found) if found else ((), ())
            yield pa.record_batch({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    members = F.collect_list(F.struct("node", *item)).alias("members")
    return groups.groupBy("cell", "value", "a", "b").agg(members).select("members").mapInArrow(run, "a bigint, b bigint")


def connect(rows: DataFrame, item: Sequence[str], build: Callable) -> DataFrame:
    """Links that connect what is near within each bucket (cell, value), from (cell, value,
    parts, node, item columns).

    A bucket of several parts is first searched part by part, a few representatives of the
    bucket being members of every part; that joins most of a family. What lies outside the
    bucket's largest group then meets every part of the bucket, pairs of parts being
    groups of their own. So every pair of a bucket is compared or already connected."""
    columns = ["cell", "value", "node", *item, "a", "b"]
    whole = rows.filter("parts = 1").withColumn("a", F.lit(0)).withColumn("b", F.lit(0)).select(columns)
    out, large = _group_links(whole, item, build), rows.filter("parts > 1")
    if large.isEmpty():
        return out
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    order = F.xxhash64("node", F.lit(1))
    stars = large.groupBy("cell", "value", "parts", F.pmod(order, F.lit(STARS)).alias("star"))
    stars = stars.agg(F.min_by(F.struct("node", *item), order).alias("m")).select("cell", "value", "parts", "m.*")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    held = ["cell", "value", "node", *item, "parts"]
    first = large.select(held).withColumn("a", part).unionByName(stars.select(held).withColumn("a", every))
    first = first.withColumn("b", F.lit(-1)).select(columns)
    out = cut(out.unionByName(_group_links(first, item, build)), "first-links")
    known = large.select(held).join(components(out).withColumnRenamed("component", "group"), "node", "left")
    known = cut(known.withColumn("group", F.coalesce("group", "node")), "large")
    counts = known.groupBy("cell", "value", "group").agg(F.count("*").alias("n"))
    main = counts.groupBy("cell", "value").agg(F.max(F.struct("n", "group")).alias("main"), F.sum("n").alias("n"))
    main = main.select("cell", "value", F.col("main.group").alias("main"), "n", (F.col("n") - F.col("main.n")).alias("rest"))
    joined = known.join(main.filter("rest > 0"), ["cell", "value"])
    joined = joined.withColumn("outside", F.ceil(F.col("rest") * F.col("parts") / F.col("n")).cast("int"))
    rest = joined.filter(F.col("group") != F.col("main"))
    rest = rest.withColumn("a", F.pmod(F.xxhash64("node", F.lit(2)), F.col("outside")).cast("int")).withColumn("b", every)
    both = joined.withColumn("b", part).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("outside") - 1)))
    return out.unionByName(_group_links(rest.select(columns).unionByName(both.select(columns)), item, build))


def _shared(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows whose bucket has others, with its size ``n`` and the columns of ``table``."""
    sizes = cut(rows.groupBy("cell", "value").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    return cut(rows.join(sizes, ["cell", "value"]).join(table, "node"), "shared")


def links(nodes: DataFrame, scheme: Scheme, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links that connect what the scheme's pairs connect, from distinct (node, fp)."""
    table = cut(pivot_table(nodes, scheme.bits), "pivots")
    shared = _shared(cell_rows(table, scheme), table)
    large = shared.filter(F.col("n") > bucket)
    if any(scheme.finer) and not large.isEmpty():
        finer = finer_rows(large.select("cell", "value", "node", "fp"), scheme).distinct()
        finer = _shared(cut(finer.withColumn("cell", F.col("cell") + len(scheme.cells)), "finer"), table)
        shared = shared.filter(F.col("n") <= bucket).unionByName(finer)
    parts = F.when(F.col("n") <= bucket, 1).otherwise(F.ceil(2 * F.col("n") / bucket)).cast("int")
    return connect(shared.withColumn("parts", parts), ["fp", "dist"], _within(scheme.radius, scheme.bits))


def _labelled(rows: DataFrame, nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with component_id, the smallest id reachable; ``key`` joins them to ``nodes``."""
    named = nodes.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named.select(key, "least", "component"), "named")
    # Written, so that a large component's join is one of two plain tables, which Spark can split.
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    by_key = cut(named.join(least, "component").select(key, "component_id"), "by-key")
    return rows.join(by_key, key)


def near_duplicates(df: DataFrame, scheme: Scheme, shingle: int = 3) -> DataFrame:
    """doc_id, row_key, fp and component_id (smallest id reachable) of every row."""
    rows = cut(fingerprints(df, shingle, scheme.bits), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("row_key").alias("node"), F.min("doc_id").alias("least")), "nodes")
    return _labelled(rows, nodes, links(nodes, scheme), "fp").select("row_key", "doc_id", "fp", "component_id")


def band_values(h: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """One value per band of min-hashes of a set of hashes; two sets share one with
    probability similarity ** band_rows."""
    rng = np.random.default_rng(13)
    mul, add, mix = (rng.integers(0, 1 << 64, bands * band_rows, np.uint64) | np.uint64(1) for _ in range(3))
    least = np.full(bands * band_rows, ~np.uint64(0))
    for at in range(0, len(h), 256):
        least = np.minimum(least, (h[at : at + 256, None] * mul + add).min(axis=0))
    return ((least ^ (least >> np.uint64(31))) * mix).reshape(bands, band_rows).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketches(rows: DataFrame, shingle: int, bits: int, bands: int, band_rows: int) -> DataFrame:
    """Of each row's set of shingles: a 128-bit hash, whether it is small, fingerprint, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [np.unique(hashes(t, shingle)) for t in part.column("text").to_pylist()]
                yield pa.record_batch({
                    "row_key": part.column("row_key"),
                    "doc_id": part.column("doc_id"),
                    "same": pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], pa.binary()),
                    "small": pa.array([len(h) < SMALL for h in sets], pa.bool_()),
                    "fp": pa.array([fingerprint(h, bits) for h in sets], pa.binary()),
                    "bands": pa.array([band_values(h, bands, band_rows) for h in sets], pa.list_(pa.int64())),
                })

    return rows.mapInArrow(run, "row_key bigint, doc_id bigint, same binary, small boolean, fp binary, bands array<bigint>")


def _within_or_small(radius: int, bits: int):
    def build(m: pa.StructArray):
        within, small = _within(radius, bits)(m), m.field("small").to_numpy(zero_copy_only=False)
        return lambda i, left: np.ones(len(left), bool) if small[i] else within(i, left) | small[left]

    return build


def _similar(percent: int):
    """Nearness of sets of hashes: exact Jaccard similarity of at least ``percent``."""

    def build(m: pa.StructArray):
        sets = [np.frombuffer(x, np.uint64) for x in m.field("set").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]
        ends = np.cumsum(np.bincount(ids))
        at = np.concatenate([[0], np.cumsum(size)])

        def near(i: int, left: np.ndarray) -> np.ndarray:
            shared = np.zeros(len(sets), np.int64)
            own = ids[at[i] : at[i + 1]]
            for k in range(0, len(own), 1024):
                lists = [owner[ends[x - 1] if x else 0 : ends[x]] for x in own[k : k + 1024]]
                shared += np.bincount(np.concatenate(lists), minlength=len(sets))
            shared = shared[left]
            return 100 * shared >= percent * (size[i] + size[left] - shared)

        return near

    return build


def near_copies(
    df: DataFrame, shingle: int, percent: int, bits: int, radius: int, bands: int, band_rows: int,
    bucket: int = BUCKET, group: int = 2048, group_hashes: int = 1 << 21,
) -> DataFrame:
    """doc_id, row_key and component_id (smallest id reachable) of every row, by texts whose
    sets of shingles have a Jaccard similarity of at least ``percent``.

    Texts that share a band of min-hashes are candidates if their fingerprints (of the set) are
    within ``radius``, or one has few shingles, for which fingerprints tell little. Candidates only
    make groups; within these every pair is compared by its sets, or already connected by such pairs."""
    keyed = unique_ids(texts(df)).select("row_key", "doc_id", "text")
    rows = cut(_sketches(keyed, shingle, bits, bands, band_rows), "sketches")
    one = rows.groupBy("same").agg(F.min_by(F.struct("fp", "small", "bands"), "row_key").alias("s"), F.min("row_key").alias("node"), F.min("doc_id").alias("least"))
    nodes = cut(one.select("same", "node", "least", "s.*"), "nodes")
    table = pivot_table(nodes, bits).join(nodes.select("node", "small"), "node")
    shared = _shared(nodes.select("node", F.posexplode("bands").alias("cell", "value")), cut(table, "pivots"))
    parts = F.when(F.col("n") <= bucket, 1).otherwise(F.ceil(2 * F.col("n") / bucket)).cast("int")
    found = connect(shared.withColumn("parts", parts), ["fp", "dist", "small"], _within_or_small(radius, bits))
    groups = cut(components(found), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                held = [np.unique(hashes(t, shingle)) for t in part.column("text").to_pylist()]
                yield pa.record_batch({
                    "value": part.column("component"),
                    "node": part.column("node"),
                    "size": pa.array([len(h) for h in held], pa.int64()),
                    "set": pa.array([h.tobytes() for h in held], pa.binary()),
                })

    chosen = keyed.withColumnRenamed("row_key", "node").join(groups, "node").select("component", "node", "text")
    members = cut(chosen.mapInArrow(sets, "value bigint, node bigint, size bigint, set binary"), "sets")
    sizes = members.groupBy("value").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    load = F.greatest(F.col("n") / group, F.col("total") / group_hashes)
    parts = F.when((load <= 1) | (F.col("n") == 2), 1).otherwise(F.least(F.ceil(2 * load), F.col("n"))).cast("int")
    sizes = cut(sizes.select("value", parts.alias("parts")), "sizes")
    buckets = members.join(sizes, "value").withColumn("cell", F.lit(0))
    exact = connect(buckets.select("cell", "value", "parts", "node", "set"), ["set"], _similar(percent))
    return _labelled(rows, nodes, exact, "same").select("row_key", "doc_id", "component_id")
