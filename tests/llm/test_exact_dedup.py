import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import exact_dedup as ed
from tallygrove.llm.common import scratch


def half():
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is not None, i or 0))
    out = []
    for g in groups.values():
        n, some, keep = min(g)
        keep = keep if some else None
        out += [(i if s else None, keep, len(g), (k, s, i) == min(g)) for k, s, i in g]
    return Counter(out)


def got(df):
    rows = df.select("doc_id", "keep_id", "group_size", "kept").collect()
    return Counter(tuple(r) for r in rows)


CASES = [
    (1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, "\x0b\x0c"), (7, "A b"), (8, "x" * 200_000), (9, "x" * 200_000),
    (10, "é"), (10, "é"), (10, "é"), (None, "n"), (None, "n"), (11, "n"), (12, "z\x1cz"), (13, "zz"), *[(100 + i, "hot") for i in range(300)],
]


def test_groups_match_brute_force(docs):
    assert got(ed.deduplicate(docs(*CASES), half())) == brute(CASES)


@pytest.mark.parametrize("is_new", [True, False])
def test_one_side_empty(docs, is_new):
    assert got(ed.deduplicate(docs(*CASES), F.lit(is_new))) == brute(CASES)


def test_colliding_digests_are_split_by_bytes(docs):
    weak = lambda t: F.substring(F.sha2(t, 256), 1, 1)
    rows = [(i, f"text {i % 40}") for i in range(120)]
    assert got(ed.deduplicate(docs(*rows), half(), weak)) == brute(rows)


def test_empty_table(docs):
    assert ed.deduplicate(docs().filter("false"), half()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 60, n, dtype=np.uint64)
    f = ed.FuseFilter.build(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 1 << 60, 100_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.01
    assert len(f.cells) < 1.2 * n + 4096


def test_snapshots_take_one_batch_after_another(docs, spark):
    """Each batch is screened by the stored filters of the snapshot before it."""
    store = ed.Snapshots(spark, scratch(spark, "snapshots"))
    rows = [(i, f"text {i * 7 % 120}" + " " * (i % 3)) for i in range(200)] + [(None, "text 1"), (900, None)]
    assert store.latest() == 0
    for k in range(3):
        batch = ed.classes_of(ed.digests(docs(*rows[k * 70 : (k + 1) * 70])))
        known = {r["digest"] for r in store.known(batch).collect()}
        before = {r["digest"] for r in store.classes(store.latest()).collect()}
        assert known == before & {r["digest"] for r in batch.collect()}
        assert store.add(batch) == k + 1
    want = {tuple(r) for r in ed.classes_of(ed.digests(docs(*rows))).collect()}
    assert {tuple(r) for r in store.classes(3).collect()} == want and store.classes(1).count() < len(want)
    store.classes(3).limit(1).write.parquet(f"{store.folder}/classes-4")  # a crash before the note
    assert store.latest() == 3 and store.add(ed.classes_of(ed.digests(docs((5000, "quite new"))))) == 4
    assert store.classes(4).count() == len(want) + 1
