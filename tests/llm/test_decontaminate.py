"""Phrases found by the index against a search word by word."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import decontaminate as dc


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def plain(docs, items, window=10):
    """[(doc_id, words, hit positions, item ids)] by comparing at every place."""
    sources = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            sources.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(p) for p in sources}:
            for k in range(len(w) - n + 1):
                if (phrase := tuple(w[k : k + n])) in sources:
                    hit |= set(range(k, k + n))
                    found |= sources[phrase]
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


@pytest.fixture()
def tables(spark):
    def build(docs, items):
        d = spark.createDataFrame([(*r, 1, ["x"]) for r in docs], "doc_id bigint, text string, n_words int, spans array<string>")
        b = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, phrase int")
        return d.repartition(4), b

    return build


def check(tables, docs, items):
    rows = dc.find(*tables(docs, items)).collect()
    got = sorted(
        ((r["doc_id"], r["n_words"], [k for s in r["spans"] for k in range(s["word"], s["word_end"])], r["item_ids"]) for r in rows), key=str
    )
    assert got == sorted(plain(docs, items), key=str)
    return rows


def corpus(seed, n_docs=300, words=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "B", "é", "Ünd", "x1", "77", "c", "d", "e"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", ".\n", "-", "_", "  "]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 25]))) for i in range(40)] + [(None, None), (None, "null item"), (3, text(12)), (4, "  ,, ")]
    items += [(100 + i, "shared passage of words that several items of the benchmark have in common") for i in range(3)]
    docs = [(i, text(rng.randrange(words))) for i in range(n_docs)] + [(None, None), (None, ""), (7, "null\0item"), (7, "NULL item")]
    for i in range(60):
        a, b = rng.choice(items)[1] or "", rng.choice(items)[1] or ""
        docs.append((1000 + i, f"{text(5)} {a} {text(3)} unknown words here {b.upper()}"))
    return docs + docs[-20:], items


def test_random(tables):
    check(tables, *corpus(1))


def test_long_items_only(tables):
    """Without short items few segments are long enough."""
    docs, items = corpus(2)
    items = [r for r in items if len(split(r[1])) > 9]
    rows = check(tables, docs, items)
    for r in rows:
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_blocks(tables, monkeypatch):
    """Many blocks of phrases give what one gives."""
    docs, items = corpus(3)
    one = sorted(map(str, dc.find(*tables(docs, items)).collect()))
    monkeypatch.setattr(dc, "BLOCK_PHRASES", 60)
    assert sorted(map(str, dc.find(*tables(docs, items)).collect())) == one


def test_empty(tables):
    docs, items = corpus(4, 20)
    check(tables, docs, [])
    check(tables, [], items)
    check(tables, docs, [(1, None), (2, " .")])


def test_spans_cut_the_text(tables, spark):
    item = "One two three four five six seven eight nine ten eleven"
    docs = [(1, f"é Before, {item.upper()}! after"), (2, "clean"), (3, item), (4, f"{item} {item}")]
    found = dc.find(*tables(docs, [(9, item)])).join(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id")
    got = dict(found.select("doc_id", dc.remove(F.col("text"), F.col("spans"))).collect())
    assert got == {1: "é Before, ! after", 2: "clean", 3: "", 4: ""}


def test_very_long_text(monkeypatch):
    """Text split slice by slice; segments longer than a shard, in overlapping pieces."""
    monkeypatch.setattr(dc, "SLICE", 50)
    monkeypatch.setattr(dc, "SHARD", 64)
    rng = random.Random(5)
    words = [rng.choice("abc") for _ in range(3000)]
    items = [(1, " ".join(words[100:115])), (2, " ".join(words[1990:2004])), (3, "c c a")]
    phrases = sorted({" ".join(split(t)[i : i + 10]) for _, t in items for i in range(max(1, len(split(t)) - 9))})
    block = dc.Phrases(phrases)
    docs = [" ".join(words), "zz " + " ".join(words[:130]), "", "é " * 70]
    found = dc.search_shard([dc.word_ids(t, block.vocabulary) for t in docs], block)
    for (spans, which), (_, n, hit, _), t in zip(found, plain(list(enumerate(docs)), items), docs):
        assert [k for a, b in spans for k in range(a, b)] == hit
        assert which == [i for i, p in enumerate(phrases) if f" {p} " in f" {t} "]


@pytest.mark.parametrize("top", [1, 2, 3, 9, 700])
def test_index(top):
    rng = np.random.default_rng(top)
    text = rng.integers(0, top + 1, 3000)
    text[-1], text[0] = 0, 1
    if top == 2:
        text[500:1000] = text[1500:2000] = 2
    order = dc.suffix_array(text)
    whole = [tuple(text[i : i + 1200]) for i in order[:400]]
    assert sorted(order) == list(range(3000)) and all(a <= b for a, b in zip(whole, whole[1:]))
    index = dc.FmIndex(text)
    phrases = np.zeros((300, 4), np.int64)
    lengths = rng.integers(1, 5, 300)
    for i, n in enumerate(lengths):
        at = rng.integers(0, 2990)
        phrases[i, 4 - n :] = text[at : at + n] if i % 3 else rng.integers(1, top + 1, n)
    good = (phrases > 0).sum(axis=1) == lengths
    phrases, lengths = phrases[good], lengths[good]
    which, low, high = index.search(phrases, lengths)
    got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high) if b > a}
    for i, n in enumerate(lengths):
        want = [k for k in range(3000 - n + 1) if (text[k : k + n] == phrases[i, 4 - n :]).all()]
        assert got.get(i, []) == want
    words = rng.integers(0, top + 1, 50)
    at = rng.integers(0, 3001, 50)
    assert index.rank(words, at).tolist() == [int((index.bwt[:a] == w).sum()) for w, a in zip(words, at)]
