"""Codes against plain comparison of everything, in Python integers."""

import math
import random

import numpy as np
import pytest

from tallygrove.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, error int, v int"


@pytest.fixture()
def table(spark):
    def build(*rows):
        return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)

    return build


def plain(rows):
    """{(vec_id, vector): (code, error)} and the codebooks."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return {}, [[] for _ in range(16)]
    width = -(-max(len(r[1]) for r in rows) // 16) * 16
    step = width // 16
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(x) * 256 if abs(x) >= 2**52 else math.floor(256 * x) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    books = []
    for p in range(16):
        parts = [v[p * step : (p + 1) * step] for v in vectors]
        book = parts[:64]
        for _ in range(2):
            got = [[] for _ in book]
            for x in parts:
                got[min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e])), e))].append(x)
            book = [[sum(c) // len(g) for c in zip(*g)] if g and step else b for g, b in zip(got, book)]
        books.append(book)
    out = {}
    for r, v in zip(rows, vectors):
        code, error = "", 0
        for p, book in enumerate(books):
            x = v[p * step : (p + 1) * step]
            d, e = min((sum((a - b) ** 2 for a, b in zip(x, b_)), e) for e, b_ in enumerate(book))
            code, error = code + f"{e:02x}", error + d
        out[r[0], tuple(r[1])] = (code, error if error < 2**63 else None)
    return out, books


def compare(df, rows):
    got, books = vc.compress(df)
    want, want_books = plain(rows)
    assert books == want_books
    found = vc.label_errors(got.select("vec_id", "label", "code", "error")).collect()
    total = {}
    for r in rows:
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]):
            e = want[r[0], tuple(r[1])][1]
            total[r[2]] = None if e is None or total.get(r[2], 0) is None else total.get(r[2], 0) + e
    by_id = {}
    for (i, _), v in want.items():
        by_id.setdefault(i, []).append(v)
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    assert len(found) == len(kept)
    for r in found:
        assert (bytes(r["code"]).hex(), r["error"]) in by_id[r["vec_id"]]
        assert r["label_error"] == total[r["label"]]
    return got, books


def test_random(table):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in rng.sample(range(10**6), 900)]
    got, books = compare(table(*rows), rows)
    back = {r["vec_id"]: r["v"] for r in vc.decompress(got, books).collect()}
    off = [abs(a - b) for i, v, _ in rows for a, b in zip(v, back[i])]
    assert sum(off) / len(off) < 0.2


def test_dropped_copies_and_ties(table):
    nan, inf = math.nan, math.inf
    same = [0.5] * 16
    rows = [(5, None, 1), (6, [None] + same[1:], 1), (7, [nan] * 16, 1), (8, [-inf] * 16, 2), (9, same, None), (None, [0.25] * 16, None)]
    rows += [(i, same, 3) for i in range(100, 180)] + [(i, [(i % 3) / 256 - 1 / 512] * 16, 3) for i in range(180, 260)] + [(300, [1.0] * 16, 3)] * 2
    compare(table(*rows), rows)


def test_lengths(table):
    rows = [(i, [((i * 7 + k) % 11) - 5.5 for k in range(n)], i % 2) for i, n in enumerate([5, 20, 0, 33, 16, 17] * 5)]
    compare(table(*rows), rows)
    only_empty = [(1, [], 1), (2, [], None)]
    compare(table(*only_empty), only_empty)


def test_huge_components(table):
    rows = [(i, [(-1.0) ** k * 10.0 ** (i % 5 * 40) * (k + 1) for k in range(16)], 1 if i % 5 < 1 else 2) for i in range(70)]
    rows += [(100, [1e308] * 16, 4), (101, [2.0**27] * 16, 5)]
    compare(table(*rows), rows)


def test_empty(table):
    got, _ = vc.compress(table())
    assert vc.label_errors(got).count() == 0


def test_trees(table):
    """Balls hold their points, caches are right, most points are never compared one by one."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-500, 500, (40, 4))
    points = centres[rng.integers(0, 40, 4000)] + rng.integers(-6, 7, (4000, 4))
    tree = vc.build_tree(points)
    assert (tree["points"][tree["row_point"]] == points).all()
    for (lo, hi, one, two), s, n, c, r in zip(tree["balls"], tree["sums"], tree["counts"], tree["centres"], tree["radii"]):
        inside, w = tree["points"][lo:hi], tree["weights"][lo:hi]
        assert (s == (inside * w[:, None]).sum(axis=0)).all() and n == w.sum()
        assert np.sqrt(((inside - c) ** 2).sum(axis=1)).max() <= r + 1e-9
        assert one < 0 or (tree["balls"][one][0], tree["balls"][two][1]) == (lo, hi)
    nearest, owned = np.full(len(tree["points"]), -1), 0
    for ball, lo, hi, owner in vc.owners(tree, centres):
        nearest[lo:hi] = owner
        owned += (hi - lo) * (ball is not None)
    assert (nearest == vc.squares(tree["points"], centres).argmin(axis=1)).all()
    assert owned > 0.5 * len(nearest)
