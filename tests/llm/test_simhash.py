import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallygrove.llm import simhash as sh
from tallygrove.llm.components import components
from tallygrove.llm.queries import QUERIES

FULL = (1 << 64) - 1


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, f"{fp:016x}", least.get(root(i))) for i, ((doc, _), fp) in enumerate(zip(rows, fps)))


def got(df):
    return Counter((r["doc_id"], bytes(r["fp"]).hex(), r["component_id"]) for r in df.collect())


def test_whole_table_matches_brute_force(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    out = QUERIES["op4_simhash_dedup"](spark, sf_dir).collect()
    assert Counter(tuple(r) for r in out) == brute(rows)


def test_odd_rows(docs):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One two"), (6, base), (6, base), (7, base + " more"), (None, base), (None, "alone here"), (8, "É é x"), (9, "é É x")]
    assert got(sh.near_duplicates(docs(*rows), sh.exact_scheme())) == brute(rows)
    assert sh.near_duplicates(docs().filter("false"), sh.exact_scheme()).count() == 0


def bit_flips(rng, centre, n, most):
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bucket", [8192, 20])
def test_links_join_what_is_near(spark, bucket):
    rng = random.Random(3)
    fps = bit_flips(rng, rng.getrandbits(64), 120, 5) + bit_flips(rng, rng.getrandbits(64), 60, 8) + [rng.getrandbits(64) for _ in range(100)]
    nodes = spark.createDataFrame([(i, x.to_bytes(8, "big")) for i, x in enumerate(fps)], "node bigint, fp binary")
    label = {r["node"]: r["component"] for r in components(sh.links(nodes, sh.exact_scheme(), bucket)).collect()}
    want = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(fps):
            near = min(want[j] for j, y in enumerate(fps) if (x ^ y).bit_count() <= 3)
            if near < want[i]:
                want[i], changed = near, True
    assert [label.get(i, i) for i in range(len(fps))] == want


def test_exact_cells_meet_at_every_distance_up_to_three():
    scheme = sh.exact_scheme()
    rng = random.Random(1)
    for _ in range(300):
        flips = set(rng.sample(range(64), 3))
        hit = [k for k, c in enumerate(scheme.cells) if not flips & set(c)]
        assert hit and all(any(not flips & set(f) for f in scheme.finer[k]) for k in hit)


def test_components_of_long_and_wide_graphs(spark):
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(500, i) for i in range(501, 700)]
    rows = spark.createDataFrame(chain + star + [(9, 9), (8, 7), (7, 8)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(rows).collect()}
    assert got == {i: 200 for i in range(200, 261)} | {i: 500 for i in range(500, 700)} | {7: 7, 8: 7}
    assert components(rows.filter("false")).count() == 0


def test_wide_fingerprints_estimate_similarity():
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    near = list(words)
    for i in rng.sample(range(400), 4):
        near[i] = "edited"
    a, b, c = (np.frombuffer(sh.fingerprint(sh.hashes(" ".join(w), 5), 256), np.uint8) for w in (words, near, words[::-1]))
    assert np.bitwise_count(a ^ b).sum() < 39 < 90 < np.bitwise_count(a ^ c).sum()


def test_sampled_cells_end_on_a_family_no_split_shrinks(spark):
    """Near copies that agree in most places stay together however often a bucket is split."""
    rng = random.Random(5)
    scheme = sh.sampled_scheme(256, 39, 6, 8)
    centre = rng.getrandbits(256)
    fps = {centre}
    while len(fps) < 150:
        fps.add(centre ^ (1 << rng.randrange(256)) ^ (1 << rng.randrange(256)))
    nodes = spark.createDataFrame([(i, x.to_bytes(32, "big")) for i, x in enumerate(sorted(fps))], "node bigint, fp binary")
    got = {r["node"]: r["component"] for r in components(sh.links(nodes, scheme, 20)).collect()}
    assert got == {i: 0 for i in range(150)}


def test_bucket_size_changes_no_result_of_sampled_cells(spark):
    rng = random.Random(6)
    scheme = sh.sampled_scheme(256, 39, 3, 2)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(256)
        fps |= {centre, centre ^ sum(1 << b for b in rng.sample(range(256), 37))}
    nodes = spark.createDataFrame([(i, x.to_bytes(32, "big")) for i, x in enumerate(sorted(fps))], "node bigint, fp binary")
    one, many = ({r["node"]: r["component"] for r in components(sh.links(nodes, scheme, b)).collect()} for b in (8192, 8))
    assert one and one == many
