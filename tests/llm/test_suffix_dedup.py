import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallygrove.llm import suffix_dedup as sd
from tallygrove.llm.queries import QUERIES


def brute(rows, length=200):
    datas = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + length] for _, d in datas for p in range(len(d) - length + 1))
    out = Counter()
    for i, d in datas:
        gone = np.zeros(len(d) + 1, np.int64)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p] += 1
                gone[min(p + length, len(d))] -= 1
        flags = np.cumsum(gone)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~flags])
        out[i, len(d), int(flags.sum()), len(sd._spans(flags)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def digest(df):
    out = Counter()
    for r in df.collect():
        n = sum(s["stop"] - s["start"] for s in r["spans"])
        out[r["doc_id"], r["n_bytes"], n, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()] += 1
    return out


def test_whole_table_matches_brute_force(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = Counter(tuple(r) for r in QUERIES["op3_suffix_dedup"](spark, sf_dir).collect())
    assert got == brute(rows)


def texts_with_repeats(seed, n=60):
    """Few letters, so that grams repeat by chance too, and shared passages of many lengths."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abé \n", k=rng.randint(30, 150))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(passages) if rng.random() < 0.7 else "".join(rng.choices("ab", k=rng.randint(1, 60))))
        rows.append((i, "".join(parts)))
    return rows + [(n, "a" * 700), (n + 1, "ab" * 150), (n + 2, None), (n + 3, ""), (n + 3, "dup " * 90), (n + 3, "dup " * 90), (None, rows[0][1])]


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 60, 16, 10**6), (2, 60, 16, 20), (3, 33, 32, 10**6), (4, 200, 32, 10**6)])
def test_random_texts(docs, monkeypatch, seed, length, gram, hot):
    monkeypatch.setattr(sd, "BUCKET_PLACES", 500)
    rows = texts_with_repeats(seed)
    assert digest(sd.remove_repeats(docs(*rows).repartition(5), length, gram, hot)) == brute(rows, length)


def test_empty_and_long(docs):
    assert sd.remove_repeats(docs().filter("false")).count() == 0
    long = "".join(random.Random(9).choices("abcdefgh ", k=300_000))
    rows = [(1, long), (2, "x" + long[1000:2000] + "y" + long[150_000:150_199])]
    assert digest(sd.remove_repeats(docs(*rows))) == brute(rows)


def test_merge_never_compares_known_prefixes(monkeypatch):
    rng = random.Random(5)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 30))) for _ in range(400)]
    runs = [sorted(strings[k::7]) for k in range(7)] + [[]]
    calls = []
    real = sd.common
    coded = [sd.front_coded(r) for r in runs]
    monkeypatch.setattr(sd, "common", lambda a, b, at: calls.append((a, b, at)) or real(a, b, at))
    out = list(sd.merge([sd.decoded(s, [len(t) for t in tails], b"".join(tails)) for s, tails in coded]))
    assert [s for s, _, _ in out] == sorted(strings)
    last = b""
    for s, n, _ in out:
        assert n == real(last, s, 0)
        last = s
    assert all(a[:at] == b[:at] for a, b, at in calls) and sum(at > 0 for _, _, at in calls) > len(calls) / 2
    assert list(sd.merge([])) == [] and [s for s, _, _ in sd.merge([[(b"a", 0), (b"ab", 1)]])] == [b"a", b"ab"]


def test_large_groups_equal_pairs():
    rng = random.Random(6)
    for _ in range(40):
        rows = sorted((bytes(rng.choices(b"ab", k=rng.randint(4, 10))), bytes(rng.choices(b"ab", k=rng.randint(0, 6)))) for _ in range(9))
        rights, lefts = [list(x) for x in zip(*rows)]
        n = [rng.choice([1, 1, 1, 2]) for _ in rows]
        shared = [0, *[sd.common(a, b, 0) for a, b in zip(rights, rights[1:])]]
        few = sd.repeated_offsets(rights, lefts, n, shared, 10)
        small, sd.SMALL_GROUP = sd.SMALL_GROUP, 0
        try:
            assert [sd._joined(x) for x in sd.repeated_offsets(rights, lefts, n, shared, 10)] == few
        finally:
            sd.SMALL_GROUP = small


@pytest.mark.parametrize("hot", [0, 5, 100, 10**6])
def test_common_anchors_are_dealt_by_their_surroundings(docs, monkeypatch, hot):
    """One passage in many documents, repeated as a whole in some, by half in others, with other
    surroundings in the rest: dealing its anchors over buckets changes nothing."""
    monkeypatch.setattr(sd, "BUCKET_PLACES", 300)
    rng = random.Random(7)

    def noise(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz é", k=n))

    short, long, around = noise(90), noise(260), [noise(130) for _ in range(4)]
    rows = []
    for i in range(150):
        middle = short if i % 3 else long
        left = rng.choice(around)[rng.randrange(130) :] if i % 2 else noise(80)
        right = rng.choice(around)[: rng.randrange(130)] if i % 5 else noise(80)
        rows.append((i, noise(20) + left + middle + right + noise(20)))
    rows += [(500, rows[3][1]), (501, rows[4][1] + "x"), (502, long * 3)]
    assert digest(sd.remove_repeats(docs(*rows).repartition(6), hot=hot)) == brute(rows)


def test_places_stay_with_the_task_that_found_them(docs, monkeypatch):
    """A bucket holds one entry per task for a passage, however many documents have it."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    rows = [(i, passage + f" number {i} " + "".join(rng.choices("abcdefgh ", k=50))) for i in range(300)]
    seen = []
    real = sd.cut
    monkeypatch.setattr(sd, "cut", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    assert digest(sd.remove_repeats(docs(*rows).repartition(4))) == brute(rows)
    runs = dict(seen)["runs"].collect()
    counted = [n for r in runs if r["bucket"] is not None for n in r["n"]]
    held = [n for r in runs if r["bucket"] is None for n in r["n"]]
    tasks = sum(r["bucket"] is None for r in runs)
    assert len(counted) == len(held) and max(counted) == 2  # a bucket knows that there are several, the task where
    common = [n for n in held if n > 2]
    assert sum(common) >= 600 and len(common) <= 6 * tasks
