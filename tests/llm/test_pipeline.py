"""Each stage against a plain version on its own input."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallygrove.llm import common, secret_scan, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage on a small table."""
    folder = "/root/testdata/sf0.01"
    docs, out = common.load(spark, folder, "documents").filter("doc_id < 600"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = common.scratch(spark, f"test-{name}")
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()])
        docs = after
    return out


def key(r):
    return tuple(r[c] for c in COLUMNS)


def test_shape(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    for name in list(stages)[:-1]:
        assert all(list(r) == COLUMNS for r in stages[name][1])


def test_toxicity(stages, spark):
    folder = "/root/testdata/sf0.01"
    before, after = stages["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in common.load(spark, folder, "labels").collect()}
    kept = {r["doc_id"] for r in after}
    dropped = [r["doc_id"] for r in before if r["doc_id"] not in kept]
    assert set(map(key, after)) <= set(map(key, before)) and dropped
    right = sum(labels.get(i) == 1 for i in dropped)
    assert right > 10 and sum(labels.get(i) == 0 for i in dropped) <= 0.1 * right


def test_exact_copies(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before:
        k = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[k] = min(best.get(k, (1, 0, None)), (-len(r["text"] or ""), r["doc_id"], key(r)))
    assert Counter(map(key, after)) == Counter(v[2] for v in best.values())


def test_near_copies(stages):
    """Groups by the true similarity of the shingle sets of the corpus; nothing else goes."""
    before, after = stages["simhash_near_dedup"]
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"] or "")) if w] for r in before]
    sets = [{" ".join(w[i : i + corpus_pipeline.SHINGLE]) for i in range(max(1, len(w) - corpus_pipeline.SHINGLE + 1))} for w in split]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= corpus_pipeline.SIMILAR * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, r in zip(group, before):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = {r["doc_id"] for g, r in zip(group, before) if least[g] == r["doc_id"]}
    assert {r["doc_id"] for r in after} == want and len(want) < len(before)


def test_secrets(stages):
    before, after = stages["secret_scan"]
    got = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    changed = 0
    for r in before:
        spans = secret_scan.scan(r["text"] or "")
        if not spans:
            assert key(got[r["doc_id"]]) == key(r)
            continue
        changed += 1
        text, at, out = r["text"], 0, ""
        for kind, a, b in spans:
            if a >= at:
                out += text[at:a] + f"[{kind}]"
            at = max(at, b)
        out += text[at:]
        assert got[r["doc_id"]]["text"] == out and got[r["doc_id"]]["n_chars"] == len(out)
        assert not [s for s in secret_scan.scan(out) if s[0] in ("access", "hex")]
    assert changed


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    tok = Tokenizer.from_file(common.tokenizer_file("word_bpe_49k.json"))
    for r in before:
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        assert sum(p["length"] for p in after if p["doc_id"] == r["doc_id"]) == n
    by = {}
    for p in after:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048


def test_repeated_and_missing_ids(spark):
    """Rows that share an id, or have none, are told apart."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "a", "s", 1), (1, long, "a", "s", 1), (1, "other text here", "a", "s", 1), (None, None, None, None, None), (None, "x", "a", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    once = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert Counter(r["text"] for r in once.collect()) == Counter([long, "other text here", None, "x"])
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert Counter(r["text"] for r in near.collect()) == Counter([long, "other text here", None, "x"])
    assert corpus_pipeline.redact_secrets(spark, docs, "").count() == 5
    empty = docs.filter("false")
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.redact_secrets, corpus_pipeline.pack):
        assert stage(spark, empty, "").count() == 0


def test_wide_radius_leaves_other_texts_alone(spark):
    rows = common.load(spark, "/root/testdata/sf0.001", "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for r in rows if len(w := r["text"].split()) > 60]
    fps = [int.from_bytes(simhash.fingerprint(simhash.hashes(r["text"], 5), 256)) for r in rows if len(r["text"].split()) > 60]
    for i in range(len(sets)):
        for j in range(i):
            jaccard = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if jaccard < 0.3:
                assert (fps[i] ^ fps[j]).bit_count() > corpus_pipeline.NEAR["radius"]
    assert toxicity.THRESHOLD == 0.5


def test_near_copies_match_true_jaccard(spark):
    """Families on either side of 0.8, a small one too, against all pairs of shingle sets."""
    rng = random.Random(8)
    texts = []
    for n, changes in [(300, k) for k in (2, 5, 6, 7, 8, 9, 10, 12)] * 12 + [(12, 0), (9, 0), (6, 0), (3, 0)] * 3:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(words))
        for i in rng.sample(range(0, n, 6), changes):
            words[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words if changes else [*words, "end"]))
    template = [f"t{i}" for i in range(200)]
    for k in range(60):
        for i in rng.sample(range(0, 200, 5), 2):
            template[i] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(template))
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((want[i], want[j]))
                want = [a if g == b else g for g in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for sizes in ({}, {"bucket": 10, "group": 10}):
        out = simhash.near_copies(docs, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR, **corpus_pipeline.NEAR, **sizes)
        assert [r["component_id"] for r in out.orderBy("doc_id").collect()] == want


def test_clashing_column_names(spark):
    """Columns that a stage might use for itself come out as they went in."""
    long = " ".join(f"w{i}" for i in range(60)) + " password = hunter2secret!"
    rows = [(i % 3, t, i, f"k{i}", "b", 1.5, ["s"], "x") for i, t in enumerate([long, long, "other words", None, "", "x " * 300])]
    schema = "doc_id bigint, text string, row_key int, ROW_KEY_ string, blob string, kept double, spans array<string>, component_id string"
    docs = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.redact_secrets):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        given = {r["row_key"]: tuple(r) for r in docs.collect()}
        for r in out.collect():
            assert [v for c, v in zip(docs.columns, r) if c != "text"] == [v for c, v in zip(docs.columns, given[r["row_key"]]) if c != "text"]
    assert {r["row_key"] for r in corpus_pipeline.drop_exact_copies(spark, docs, "").collect()} in ({0, 2, 3, 5}, {1, 2, 3, 5}, {0, 2, 4, 5}, {1, 2, 4, 5})
    assert corpus_pipeline.pack(spark, docs, "").count() == 6
