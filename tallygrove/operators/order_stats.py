"""Exact order statistics of a table of any size: deciles and the median.

``ntile`` over all rows would sort the whole table in one task. But a tile is
decided by at most n-1 boundary rows, so it is enough to find those, with two scans
of the ordering columns:

1. A mergeable quantile sketch gives values on either side of each boundary and at it.
2. Rows are counted: those between two boundaries' brackets together, those
   inside a bracket by their key. A value that the sketch itself returned may be very common;
   its rows are counted by 4096 slices of their tie key. All other values of a
   bracket together are less than 8 in SKETCH of the rows.

The counts are a small stored table, in which the boundaries are found by counting again (the
rows per slice of a range, then only in the slices with a boundary). A boundary inside a slice
of a very common value takes a third scan, of that value's rows alone. A table of
few rows is listed, and a boundary that the sketch failed to bracket is
looked for in the table itself, so the result never depends on the sketch.

No rows are shuffled but those counts. Rows are then compared with the boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.schema import AMOUNT
from tallygrove.sources.stored import stored

SKETCH = 10_000  # the sketch's rank error is one in so many rows
FANOUT = 4096  # slices per open range and pass
FEW_ROWS = 5_000  # a range with so few rows is listed instead of sliced
_COPIES_PER_STEP = 100_000
_HASH_BITS = 60
_SLICE_BITS = 12


@dataclass
class _Range:
    """Rows whose keys before ``depth`` equal ``prefix`` and whose key at
    ``depth`` lies in lo..hi. ``below`` rows of the table come before them, and
    the boundaries behind the given ranks (counted from 1) are among them."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: int
    rows: int
    ranks: list[int]

    @property
    def depth(self) -> int:
        return len(self.prefix)


@dataclass(frozen=True)
class Boundary:
    """The last row of the first ``rank`` rows has this key; ``inside`` of the
    ``equal`` rows with the key belong to them."""

    rank: int
    key: tuple[int, ...]
    inside: int
    equal: int


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _equal(levels: Sequence[Column], key: Sequence[int]) -> Column:
    return reduce(lambda a, b: a & b, [k == _long(v) for k, v in zip(levels, key)], F.lit(True))


def _above(levels: Sequence[Column], key: Sequence[int]) -> Column:
    """The row's key comes after the given one (by its first parts)."""
    parts = [
        _equal(levels, key[:i]) & (k > _long(v)) if i else k > _long(v)
        for i, (k, v) in enumerate(zip(levels, key))
    ]
    return reduce(lambda a, b: a | b, parts)


@dataclass(frozen=True)
class _Cell:
    """Rows of a range that were counted together: those whose key has exactly
    these parts (a range with few rows), or one slice with its extreme keys."""

    order: tuple[int, ...]
    rows: int
    lo: int | None
    hi: int | None


def _count_pass(
    df: DataFrame, levels: Sequence[Column], ranges: list[_Range], weight: str | None = None
) -> list[list[_Cell]]:
    """One scan for all ranges: the cells of each, in order. Their number is
    bounded, so they fit the driver whatever the table's size. FANOUT and FEW_ROWS
    change the number of scans, not the result. ``weight`` is a column that tells how many rows
    a row stands for."""
    slot, inside = None, []
    for i, r in enumerate(ranges):
        key = levels[r.depth]
        held = key.between(_long(r.lo), _long(r.hi))
        if r.depth:
            held = _equal(levels, r.prefix) & held
        if r.rows <= FEW_ROWS:
            cell, value = list(levels[r.depth :]), F.lit(None).cast("bigint")
        else:
            width = -(-(r.hi - r.lo + 1) // FANOUT)
            cell, value = [F.call_function("div", key - _long(r.lo), _long(width))], key
        place = F.struct(F.lit(i).alias("r"), F.array(*cell).alias("c"), value.alias("k"))
        slot = F.when(held, place) if slot is None else slot.when(held, place)
        inside.append(held)
    counted = (
        df.filter(reduce(lambda a, b: a | b, inside))
        .select(slot.alias("p"), (F.col(weight) if weight else F.lit(1)).alias("w"))
        .groupBy("p.r", "p.c")
        .agg(F.sum("w"), F.min("p.k"), F.max("p.k"))
        .collect()
    )
    out: list[list[_Cell]] = [[] for _ in ranges]
    for i, order, n, lo, hi in counted:
        out[i].append(_Cell(tuple(order), n, lo, hi))
    return [sorted(cells, key=lambda c: c.order) for cells in out]


def _boundaries(
    df: DataFrame, levels: Sequence[Column], todo: list[_Range], weight: str | None = None
) -> list[Boundary]:
    """Find the boundary rows behind the ranks of the given ranges in the order of the
    keys. Keys behind a range's own are hashes."""
    found: list[Boundary] = []
    while todo:
        counts = _count_pass(df, levels, todo, weight)
        nxt: list[_Range] = []
        for r, cells in zip(todo, counts):
            below = r.below
            for cell in cells:
                here = [k for k in r.ranks if below < k <= below + cell.rows]
                if cell.lo is None:
                    key = r.prefix + cell.order
                elif cell.lo == cell.hi:
                    key = (*r.prefix, cell.lo)
                else:  # several values: look into the slice
                    key = None
                    if here:
                        nxt.append(_Range(r.prefix, cell.lo, cell.hi, below, cell.rows, here))
                if key is not None:
                    last = len(key) == len(levels)
                    done = [k for k in here if last or k == below + cell.rows]
                    found += [Boundary(k, key, k - below, cell.rows) for k in done]
                    tied = [k for k in here if k not in done]
                    if tied:
                        nxt.append(_Range(key, 0, 2**_HASH_BITS - 1, below, cell.rows, tied))
                below += cell.rows
        todo = nxt
    return sorted(found, key=lambda f: f.rank)


@dataclass(frozen=True)
class _Bracket:
    """Values lo..hi, which should hold a boundary, and those the sketch returned."""

    lo: int
    hi: int
    returned: frozenset[int]


def _sketch(key: Column, fractions: Sequence[float]) -> Column:
    """For each fraction of the rows three values: two errors of the sketch before it, at it, two after."""
    step = 2 / SKETCH
    points = [min(max(f + d, 0.0), 1.0) for f in fractions for d in (-step, 0.0, step)]
    return F.percentile_approx(key, points, SKETCH)


def _brackets(values: Sequence[int] | None, lo: int, hi: int) -> list[_Bracket]:
    """The sketch's values, three by three, as ranges that do not overlap."""
    out: list[_Bracket] = []
    for i in range(0, len(values or []), 3):
        a, _, b = three = sorted(min(max(v, lo), hi) for v in values[i : i + 3])
        if out and a <= out[-1].hi:
            last = out.pop()
            a, b, three = min(a, last.lo), max(b, last.hi), [*three, *last.returned]
        out.append(_Bracket(a, b, frozenset(three)))
    return out


def _slot(key: Column, brackets: Sequence[_Bracket]) -> Column:
    """2i + 1 inside bracket i, 2i before it."""
    out = None
    for i, b in enumerate(brackets):
        for held, slot in ((key < _long(b.lo), 2 * i), (key <= _long(b.hi), 2 * i + 1)):
            out = F.when(held, _long(slot)) if out is None else out.when(held, _long(slot))
    return _long(0) if out is None else out.otherwise(_long(2 * len(brackets)))


def _ranges(counted: DataFrame, group: Sequence[str], ranks: dict[tuple, list[int]]) -> tuple[list[_Range], dict[tuple, list[int]]]:
    """Per group of slots: the brackets with the ranks they hold, and the ranks no bracket holds."""
    sums = counted.groupBy(*group, "s").agg(F.sum("n").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    todo, missed = [], {}
    for g, wanted in ranks.items():
        below, left = 0, set(wanted)
        for r in sorted((r for r in sums if tuple(r[c] for c in group) == g), key=lambda r: r["s"]):
            here = [k for k in wanted if below < k <= below + r["n"]]
            if r["s"] % 2 and here:
                todo.append(_Range((*g, r["s"]), r["lo"], r["hi"], below, r["n"], here))
                left -= set(here)
            below += r["n"]
        if left:
            missed[g] = sorted(left)
    return todo, missed


def _integer_key(df: DataFrame, measure: str) -> tuple[Column, int]:
    """The measure as a bigint of the same order, and its scale factor."""
    kind = df.schema[measure].dataType
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        scale = 10**kind.scale
        return (F.col(measure) * F.lit(scale)).cast("bigint"), scale
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.col(measure).cast("bigint"), 1
    raise TypeError(f"cannot rank by {measure} of type {kind.simpleString()}")


def tie_key(cols: Sequence[str]) -> Column:
    """A 60-bit number made of the columns' text, evenly spread."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def median(df: DataFrame, measure: str = AMOUNT) -> float | None:
    """Exact median: the middle value, or the mean of the middle two."""
    return medians(df, [measure])[measure]


def medians(df: DataFrame, measures: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of several columns. All columns share each counting job, of
    which there are a few whatever the number of columns."""
    keys = [_integer_key(df, m) for m in measures]
    figures = [f(key) for key, _ in keys for f in (F.min, F.max, F.count)]
    ends = df.agg(*figures, *[_sketch(key, [0.5]) for key, _ in keys]).first()
    sketches = ends[3 * len(keys) :]
    values = F.array(*[F.struct(_long(i).alias("c"), key.alias("k")) for i, (key, _) in enumerate(keys)])
    rows = df.select(F.inline(values)).filter("k IS NOT NULL")
    whole, bracketed, ranks, slot = {}, {}, [], _long(0)
    for i in range(len(keys)):
        lo, hi, n = ends[3 * i : 3 * i + 3]
        ranks.append(((n + 1) // 2, n // 2 + 1))
        if n:
            whole[i,] = _Range((i,), lo, hi, 0, n, sorted(set(ranks[i])))
        if n > FEW_ROWS:
            bracketed[i,] = whole[i,].ranks
            slot = F.when(F.col("c") == _long(i), _slot(F.col("k"), _brackets(sketches[i], lo, hi))).otherwise(slot)
    found = []
    if bracketed:
        large = F.col("c").isin([g[0] for g in bracketed])
        slotted = rows.filter(large).withColumn("s", slot).withColumn("k", F.when(F.col("s") % 2 == 1, F.col("k")).otherwise(_long(0)))
        counted = stored(slotted.groupBy("c", "s", "k").agg(F.count(F.lit(1)).alias("n")), "median-counts")
        todo, missed = _ranges(counted, ["c"], bracketed)
        inside = _boundaries(counted, [F.col("c"), F.col("s"), F.col("k")], todo, "n")
        found += [Boundary(b.rank, (b.key[0], b.key[2]), b.inside, b.equal) for b in inside]
        for g in bracketed:
            if g in missed:
                whole[g].ranks = missed[g]
            else:
                del whole[g]
    found += _boundaries(rows, [F.col("c"), F.col("k")], list(whole.values()))
    at = {(b.key[0], b.rank): b.key[1] for b in found}
    out: dict[str, float | None] = dict.fromkeys(measures)
    for i, (name, (_, scale)) in enumerate(zip(measures, keys)):
        if (i, ranks[i][0]) in at:
            lower, upper = (at[i, k] / scale for k in ranks[i])
            out[name] = lower + (upper - lower) * 0.5
    return out


def with_tile(
    df: DataFrame,
    measure: str,
    tiebreak: Sequence[str],
    n: int = 10,
    name: str = "tile",
    cuts: Sequence[int] | None = None,
) -> DataFrame:
    """``ntile(n)`` ordered by a measure (nulls last), exact and without a sort.

    Rows with the same measure are ordered by :func:`tie_key` of the tie-break
    columns, which spreads one very common value over the whole key range.
    Finding the boundaries runs a few counting jobs; the result itself is a
    projection of ``df``. Only where a boundary falls between full copies of one
    row does it add a second branch that deals the copies out.

    With ``cuts``, only the boundaries behind these tiles are looked for, and
    rows are numbered by the groups between them: for 10 tiles, cuts 1 and 9
    give 1 (first tile), 2 (all between) and 3 (last tile).
    """
    key, scale = _integer_key(df, measure)
    wanted = list(cuts or range(1, n))
    last = F.coalesce(key, _long(2**63 - 1))
    lo, hi, rows, values = df.agg(F.min(key), F.max(key), F.count(F.lit(1)), _sketch(last, [i / n for i in wanted])).first()
    lo, hi = (0, -1) if lo is None else (lo, hi)
    levels = [F.coalesce(key, _long(hi + 1)), tie_key(tiebreak), F.shiftrightunsigned(F.xxhash64(*df.columns), 64 - _HASH_BITS)]
    q, r = divmod(rows, n)
    ends = [i * q + min(i, r) for i in wanted]
    ranks = sorted({e for e in ends if 0 < e < rows})
    found: list[Boundary] = []
    if ranks and rows > FEW_ROWS:
        found, ranks = _tile_boundaries(df, measure, scale, levels, _brackets(values, lo, hi + 1), ranks, hi + 1)
    if ranks:
        found += _boundaries(df, levels, [_Range((), lo, hi + 1, 0, rows, ranks)])

    above = [_above(levels, b.key).cast("int") for b in found]
    out = df.withColumn(name, reduce(lambda a, b: a + b, above, F.lit(1)))
    split: dict[tuple[int, ...], list[int]] = {}  # key of copies -> ranks inside
    for b in found:
        if b.inside < b.equal:
            split.setdefault(b.key, []).append(b.inside)
    if not split:
        return out
    whole = reduce(lambda a, b: a & b, [~_equal(levels, k) for k in split])
    parts = [out.filter(whole)]
    parts += [
        _deal_copies(out.filter(_equal(levels, k)), df.columns, ranks, name)
        for k, ranks in split.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _tile_boundaries(
    df: DataFrame, measure: str, scale: int, levels: Sequence[Column], brackets: list[_Bracket], ranks: list[int], null: int
) -> tuple[list[Boundary], list[int]]:
    """Boundaries found in the counts of the second scan, and the ranks that no bracket holds. ``null``
    is the key of rows without the measure."""
    key, tie, copy = levels
    returned = sorted({v for b in brackets for v in b.returned})
    slot = _slot(key, brackets)
    width = _HASH_BITS - _SLICE_BITS
    row = df.select(slot.alias("s"), key.alias("k"), tie.alias("t"), copy.alias("h"))
    inside, common = F.col("s") % 2 == 1, F.col("k").isin(returned)
    zero = _long(0)
    cells = row.select(
        "s", F.when(inside, F.col("k")).otherwise(zero).alias("k"),
        # slices are numbered from 1; 0 is a row with its own key
        F.when(inside & common, F.shiftright("t", width) + 1).otherwise(zero).alias("slice"),
        F.when(inside & ~common, F.col("t")).otherwise(zero).alias("t"), F.when(inside & ~common, F.col("h")).otherwise(zero).alias("h"),
    )
    counted = stored(cells.groupBy("s", "k", "slice", "t", "h").agg(F.count(F.lit(1)).alias("n")), "tile-counts")
    todo, missed = _ranges(counted, [], {(): ranks})
    found, open_slices = [], {}
    for b in _boundaries(counted, [F.col(c) for c in ("s", "k", "slice", "t", "h")], todo, "n"):
        value, rest = b.key[1], b.key[2:]
        if not rest:
            found.append(Boundary(b.rank, (value,), b.inside, b.equal))
        elif rest[0] == 0:
            found.append(Boundary(b.rank, (value, *rest[1:]), b.inside, b.equal))
        elif b.inside == b.equal:  # between two slices
            found.append(Boundary(b.rank, (value, (rest[0] << width) - 1), b.inside, b.equal))
        else:
            open_slices.setdefault((value, rest[0] - 1, b.equal), {})[b.inside] = b.rank
    if open_slices:
        found += _slice_boundaries(df, measure, scale, levels, open_slices, null)
    return sorted(found, key=lambda f: f.rank), missed.get((), [])


def _slice_boundaries(
    df: DataFrame, measure: str, scale: int, levels: Sequence[Column], slices: dict[tuple[int, int, int], dict[int, int]], null: int
) -> list[Boundary]:
    """Boundaries inside slices (value, number, rows) of very common values: {rank inside: rank}. The
    scan's filter compares the column itself, so files without the values are skipped."""
    key, tie, copy = levels
    width, which, held = _HASH_BITS - _SLICE_BITS, None, []
    for i, (value, number, _) in enumerate(slices):
        same = F.col(measure).isNull() if value == null else F.col(measure) == F.lit(Decimal(value) / scale).cast(df.schema[measure].dataType)
        held.append(same)
        here = (key == _long(value)) & tie.between(_long(number << width), _long(((number + 1) << width) - 1))
        which = F.when(here, _long(i)) if which is None else which.when(here, _long(i))
    rows = df.filter(reduce(lambda a, b: a | b, held)).select(which.alias("i"), tie.alias("t"), copy.alias("h"))
    counted = stored(rows.filter("i IS NOT NULL").groupBy("i", "t", "h").agg(F.count(F.lit(1)).alias("n")), "slice-counts")
    todo = [
        _Range((i,), number << width, ((number + 1) << width) - 1, 0, n, sorted(ranks))
        for i, ((_, number, n), ranks) in enumerate(slices.items())
    ]
    values, ranks = [k[0] for k in slices], list(slices.values())
    return [
        Boundary(ranks[b.key[0]][b.rank], (values[b.key[0]], *b.key[1:]), b.inside, b.equal)
        for b in _boundaries(counted, [F.col("i"), F.col("t"), F.col("h")], todo, "n")
    ]


def _deal_copies(rows: DataFrame, cols: list[str], ranks: list[int], name: str) -> DataFrame:
    """Rows that are copies of one another, dealt out to tiles: up to each rank
    they stay in the tile, behind it they move to the next. The copies meet as a
    count per distinct row and are spread again in steps of bounded size."""
    distinct = rows.groupBy(*cols, name).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(*[F.asc_nulls_last(c) for c in cols])
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = distinct.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_n"))
    edges = [0, *ranks, None]
    pieces = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.greatest(F.col("_lo"), F.lit(a)).alias("a"),
                (F.col("_hi") if b is None else F.least(F.col("_hi"), F.lit(b))).alias("b"),
            )
            for i, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
    )
    dealt = (
        spans.select(*cols, name, F.inline(pieces))
        .filter(F.col("b") > F.col("a"))
        .withColumn(name, F.col(name) + F.col("step"))
    )
    chunk = F.lit(_COPIES_PER_STEP)
    starts = F.sequence(F.lit(0), ((F.col("b") - F.col("a") - 1) / chunk).cast("bigint"))
    stepped = dealt.withColumn("_c", F.explode(starts)).repartition("_c")
    left = F.least(F.col("b") - F.col("a") - F.col("_c") * chunk, chunk)
    return stepped.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), left))).select(
        *cols, name
    )


_SALE_IDS = ["transaction_id", "product_id", "customer_id", "receipt_number"]


def with_decile(
    df: DataFrame, measure: str = AMOUNT, tiebreak: Sequence[str] = _SALE_IDS
) -> DataFrame:
    """Decile of each row: 1 (smallest tenth) to 10."""
    return with_tile(df, measure, tiebreak, 10, "value_decile")


def with_outer_deciles(
    df: DataFrame, measure: str = AMOUNT, tiebreak: Sequence[str] = _SALE_IDS
) -> DataFrame:
    """Only the outer deciles told apart: 1 (smallest tenth), 2, 3 (largest
    tenth). A table of fewer than ten rows has no largest tenth."""
    return with_tile(df, measure, tiebreak, 10, "value_group", cuts=[1, 9])
