"""Vector codes: product codebooks, fitted and applied through metric trees.

A vector's components become integers, floor(256 * x), and are cut into equal parts.
Each part position has a codebook of at most 64 entries; a vector's code is the index
of the nearest entry at each position.

Trees are built once, middle-out. A block of rows holds one anchors hierarchy per part
position: about sqrt(n) anchors, each new one the point farthest from its anchor, take
the points nearest to them (points that the triangle inequality keeps from the new
anchor are not looked at); anchors are merged bottom-up by the least ball around two,
and refined top-down in the same way. Every ball caches the sum and the count of its
points. A round walks the trees with a list of candidate entries: a ball inherits its
parent's list and drops each entry that lies farther than another from every point of
the ball, so lists shrink until one entry owns the ball, whose cached sum and count then
stand for its points. Only points in leaves with several candidates are compared one by
one. Rounding cannot drop an entry that might win (the test has slack), and comparisons
in leaves are exact integers, so results equal those of comparing everything.

Spark deals blocks to tasks; the trees are a written table. What leaves a task in a round
is one partial sum per entry, added up by Spark; the driver holds the codebooks alone (64
vectors). Copies of a point within a block are one point with a weight.

* Rows whose vector is null or holds null, NaN or infinite components are dropped; an
  empty vector holds none, all its parts are empty and its error is 0.
* Vectors of unequal length, or of one that the number of parts does not divide, are
  filled up with zeros at the end to the least length that suits all.
* Null ids are kept and count as the largest; rows of equal id are ordered by their vectors. Repeated rows are
  each returned. Fewer rows than entries: as many entries as rows. No rows: no result.
* Components of any size are computed exactly; an error beyond 64 bits is null, and so is the total of its label.
* Other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, ship_package

PARTS = 16
ENTRIES = 64
ROUNDS = 2
LEAF = 64  # points in a ball that is not refined
BLOCK = 2**18  # components in a block, about
BROADCAST_ROWS = 100_000

_NARROW = 2**24  # below it squared distances and sums of a block fit into 64 bits
_FLOATS = 1e100  # above it float64 could overflow: such a block is one ball
_LIMB = 48
_LONG = 2**63

Codebooks = list[list[list[int]]]  # part, entry, position


# ---- one block, within a task ----


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x): int64 where that is exact, else Python integers."""
    if not values.size or np.abs(values).max() < _NARROW / 256:
        return np.floor(values * 256).astype(np.int64)
    whole = [int(x) * 256 if abs(x) >= 2**52 else math.floor(x * 256) for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def _anchors(points: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The anchor, numbered from 0, that owns each member."""
    p = points[members]
    owner, at = np.zeros(len(p), np.int64), [0]
    dist = _distances(p, p[0])
    for new in range(1, math.isqrt(len(p) - 1) + 1):
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        gap = _distances(p[at], p[far])
        seen = np.flatnonzero(dist > gap[owner] / 2)  # the others are nearer to their own anchor
        nearer = _distances(p[seen], p[far])
        taken = nearer < dist[seen]
        owner[seen[taken]], dist[seen[taken]] = new, nearer[taken]
        at.append(far)
    return owner


def _merged(balls: list[tuple]) -> tuple:
    """(shape, centre, count, radius) of the tree that joins the balls, least ball first."""
    k, size = len(balls), 2 * len(balls) - 1
    shape: list = [b[0] for b in balls]
    centre = np.zeros((size, len(balls[0][1])))
    count, radius = np.zeros(size), np.zeros(size)
    for i, b in enumerate(balls):
        centre[i], count[i], radius[i] = b[1:]
    cost = np.full((size, size), np.inf)

    def fill(i: int, others: np.ndarray) -> None:
        gap, n = _distances(centre[others], centre[i]), count[others] + count[i]
        cost[i, others] = np.maximum(gap * count[others] / n + radius[i], gap * count[i] / n + radius[others])

    for i in range(1, k):
        fill(i, np.arange(i))
    live = np.zeros(size, bool)
    live[:k] = True
    for new in range(k, size):
        i, j = divmod(int(cost.argmin()), size)
        count[new] = count[i] + count[j]
        centre[new] = (centre[i] * count[i] + centre[j] * count[j]) / count[new]
        radius[new] = cost[i, j]
        shape.append((shape[i], shape[j]))
        live[[i, j]] = False
        cost[[i, j], :] = np.inf
        cost[:, [i, j]] = np.inf
        fill(new, np.flatnonzero(live))
        live[new] = True
    return shape[-1], centre[-1], count[-1], radius[-1]


def _shape(points: np.ndarray, weights: np.ndarray, members: np.ndarray) -> tuple:
    """Nested pairs of member lists, with the ball around them."""
    if len(members) > LEAF:
        owner = _anchors(points, members)
        if owner.any():
            return _merged([_shape(points, weights, members[owner == a]) for a in range(owner.max() + 1) if (owner == a).any()])
    n = weights[members].sum()
    centre = (points[members] * weights[members, None]).sum(axis=0) / n
    return members, centre, n, _distances(points[members], centre).max()


def _distinct(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and which of them each row is."""
    if whole.dtype == object or not whole.shape[1]:
        rows = [tuple(r) for r in whole.tolist()]
        number = {r: i for i, r in enumerate(sorted(set(rows)))}
        points = np.array(list(number), dtype=whole.dtype).reshape(len(number), whole.shape[1])
        return points, np.fromiter((number[r] for r in rows), np.int64, len(rows))
    order = np.lexsort(whole.T)
    ordered = whole[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    which = np.empty(len(whole), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def build_tree(whole: np.ndarray) -> dict:
    """The tree over the rows of one part: distinct points in the order of its leaves, and its
    balls, parents first, each with the range of its points and its cached sum and count."""
    points, row_point = _distinct(whole)
    weights = np.bincount(row_point)
    everything = np.arange(len(points))
    plain = not whole.size or abs(whole).max() < _FLOATS
    shape = _shape(points.astype(float), weights, everything)[0] if plain else everything
    order: list[int] = []
    balls: list[list] = []

    def flatten(node) -> int:
        me = len(balls)
        balls.append([len(order), 0, -1, -1])
        if isinstance(node, tuple):
            balls[me][2] = flatten(node[0])
            balls[me][3] = flatten(node[1])
        else:
            order.extend(node.tolist())
        balls[me][1] = len(order)
        return me

    flatten(shape)
    points, weights = points[order], weights[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first, end = np.array(balls)[:, :2].T
    none = np.zeros((1, points.shape[1]), points.dtype)
    upto = np.concatenate([none, np.cumsum(points * weights[:, None], axis=0)])
    sums = list(upto[end] - upto[first])
    counts = np.diff(np.concatenate([[0], np.cumsum(weights)])[np.stack([first, end])], axis=0)[0].tolist()
    centres = [s.astype(float) / n if plain else None for s, n in zip(sums, counts)]
    radii = [float(_distances(points[b[0] : b[1]].astype(float), c).max()) if plain else math.inf for b, c in zip(balls, centres)]
    return {
        "points": points.astype(np.int32) if points.dtype != object else points,
        "weights": weights.astype(np.int32), "row_point": place[row_point].astype(np.int32),
        "balls": balls, "sums": sums, "counts": counts, "centres": centres, "radii": radii,
    }


def shrink(centre: np.ndarray, radius: float, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The candidates of a ball: without those that are farther than the one nearest to the
    centre from every point of the ball, which the plane between the two decides."""
    e = entries[left]
    far = ((e - centre) ** 2).sum(axis=1)
    best = int(far.argmin())
    slack = 1e-9 * (far.max() + radius * radius + (centre**2).sum() + (e**2).sum(axis=1).max())
    return left[far - far[best] <= 2 * radius * _distances(e, e[best]) * (1 + 1e-9) + slack]


def owners(tree: dict, entries: np.ndarray) -> Iterator[tuple[int | None, int, int, np.ndarray | int]]:
    """(ball or None, first point, end, owner) for ranges of points that cover the tree: a whole
    ball with its only owner, or the points of a leaf with one owner each. Ties: lower index."""
    first = {}
    for i, e in enumerate(map(tuple, entries.tolist())):
        first.setdefault(e, i)  # a later copy of an entry never wins
    floats = entries.astype(float) if not entries.size or abs(entries).max() < _FLOATS else None
    todo = [(0, np.array(sorted(first.values())))]
    while todo:
        me, left = todo.pop()
        lo, hi, one, two = tree["balls"][me]
        if len(left) > 1 and tree["centres"][me] is not None and floats is not None:
            left = shrink(tree["centres"][me], tree["radii"][me], floats, left)
        if len(left) == 1:
            yield me, lo, hi, int(left[0])
        elif one >= 0:
            todo += [(one, left), (two, left)]
        else:
            yield None, lo, hi, left[squares(tree["points"][lo:hi], entries[left]).argmin(axis=1)]


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by entries."""
    if points.dtype == object or entries.dtype == object:
        points, entries = points.astype(object), entries.astype(object)
        return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2) + np.zeros((len(points), len(entries)), object)
    return ((points[:, None, :].astype(np.int64) - entries[None, :, :]) ** 2).sum(axis=2)


# ---- tasks ----


def _blocks(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most = min(4096, max(256, BLOCK // max(width, 1)))
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            b = batch.slice(start, most)
            lists = b.column("v")
            if all(n == width for n in lists.value_lengths().to_pylist()):
                values = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            else:
                values = np.zeros((b.num_rows, width))
                for i, v in enumerate(lists.to_pylist()):
                    values[i, : len(v)] = v
            whole, step = integers(values), width // PARTS
            trees = [build_tree(whole[:, p * step : (p + 1) * step]) for p in range(PARTS)]
            ids, labels = (pa.ListArray.from_arrays([0, b.num_rows], b.column(c)) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([pickle.dumps(trees)], pa.binary())], ["vec_id", "label", "trees"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[dict]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, pickle.loads(batch.column("trees")[i].as_py())


def _arrays(books: Codebooks) -> list[np.ndarray]:
    wide = any(abs(x) >= _NARROW for b in books for e in b for x in e)
    return [np.array(b, dtype=object if wide else np.int64).reshape(len(b), len(b[0]) if b else 0) for b in books]


def _sums(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts of a task's points by entry. Position -1 is the count; a sum of more than
    62 bits is dealt over limbs, which Spark adds up one by one."""
    arrays = _arrays(books)
    total: dict[tuple[int, int], list] = {}
    for _, _, trees in _trees(batches):
        for p, (tree, entries) in enumerate(zip(trees, arrays)):
            for ball, lo, hi, owner in owners(tree, entries):
                if ball is not None:
                    found = [(owner, tree["sums"][ball], tree["counts"][ball])]
                else:
                    points, weights = tree["points"][lo:hi], tree["weights"][lo:hi]
                    weighted = points.astype(object if points.dtype == object else np.int64) * weights[:, None]
                    found = [(int(e), weighted[owner == e].sum(axis=0), int(weights[owner == e].sum())) for e in np.unique(owner)]
                for e, s, n in found:
                    old = total.setdefault((p, e), [0, [0] * len(s)])
                    old[0] += n
                    old[1] = [a + b for a, b in zip(old[1], s.tolist())]
    out = []
    for (p, e), (n, s) in total.items():
        for at, value in enumerate([n, *s], -1):
            limb = 0
            while not -(2**62) <= value < 2**62:
                out.append((p, e, at, limb, value & (2**_LIMB - 1)))
                value, limb = value >> _LIMB, limb + 1
            out.append((p, e, at, limb, value))
    columns = list(zip(*out)) or [[]] * 5
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "entry", "position", "limb", "value"])


def _codes(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrays = _arrays(books)
    for batch, i, trees in _trees(batches):
        ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("vec_id", "label"))
        code, error = np.zeros((len(ids), len(trees)), np.uint8), 0
        for p, (tree, entries) in enumerate(zip(trees, arrays)):
            nearest = np.zeros(len(tree["points"]), np.int64)
            for _, lo, hi, owner in owners(tree, entries):
                nearest[lo:hi] = owner
            points = tree["points"]
            exact = object if object in (points.dtype, entries.dtype) else np.int64
            away = ((points.astype(exact) - entries[nearest].astype(exact)) ** 2).sum(axis=1) + np.zeros(len(points), exact)
            code[:, p] = nearest[tree["row_point"]]
            error = error + away.astype(object)[tree["row_point"]]
        errors = pa.array([int(x) if x < _LONG else None for x in error], pa.int64())
        codes = pa.array([row.tobytes() for row in code], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, labels, codes, errors], ["vec_id", "label", "code", "error"])


# ---- Spark ----


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error), codebooks): code is one byte per part."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter(F.col("v").isNotNull() & F.forall("v", _finite))
    label_type = rows.schema["label"].dataType.simpleString()
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = -(-(longest or 0) // PARTS) * PARTS
    step = width // PARTS
    blocks = cut(
        rows.mapInArrow(partial(_blocks, width), f"vec_id array<bigint>, label array<{label_type}>, trees binary"), "vector-trees"
    )
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    padded = [integers(np.array([*r["v"], *[0.0] * (width - len(r["v"]))])).tolist() for r in first]
    books: Codebooks = [[v[p * step : (p + 1) * step] for v in padded] for p in range(PARTS)]
    for _ in range(ROUNDS if first else 0):
        added = blocks.mapInArrow(partial(_sums, books), "part int, entry int, position int, limb int, value bigint")
        total: dict[tuple[int, int], dict[int, int]] = {}
        for r in added.groupBy("part", "entry", "position", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect():
            at = total.setdefault((r["part"], r["entry"]), {})
            at[r["position"]] = at.get(r["position"], 0) + (int(r["s"]) << _LIMB * r["limb"])
        books = [
            [[s[i] // s[-1] for i in range(step)] if (s := total.get((p, e))) else old for e, old in enumerate(book)]
            for p, book in enumerate(books)
        ]
    coded = blocks.mapInArrow(partial(_codes, books), f"vec_id bigint, label {label_type}, code binary, error bigint")
    return cut(coded, "vector-codes"), books


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with the error summed over equal labels, null labels together."""
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("bigint")
    totals = cut(rows.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")), "label-errors")
    few = totals.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")


def codebooks_text(books: Codebooks) -> str:
    return ",".join(str(x) for book in books for entry in book for x in entry)


def codebooks_sha256(books: Codebooks) -> str:
    return hashlib.sha256(codebooks_text(books).encode()).hexdigest()


def decompress(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, v): the middle of the cell each code stands for, filled-up zeros included."""
    table = F.lit([[[(x + 0.5) / 256 for x in e] for e in book] for book in books] or [[[0.0]]])
    entry = [table[p][F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")] for p in range(len(books))]
    return rows.select("vec_id", "label", F.concat(*entry).alias("v"))
