import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallygrove.llm import packing, token_files
from tallygrove.llm.common import scratch, tokenizer_file
from tallygrove.llm.encoding import ChunkEncoder
from tallygrove.llm.queries import QUERIES

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", " a\n b \n\n c", "x\n\ny\n\n z", "don't  'll \t\tx", "\x00 a\x00b \x00", "<|endoftext|> a<|endoftext|>",
    "a <|startoftext|>b", "é́ ́x ΑΣ Σ ß", "12 345 6,7.", "日本 語　x  y", "a  b\x1c c \x1d", "It's  (ok) . .. ...\n", "İI ı",
    "word " * 500, "tab\tsep \r\n x", " \n", "\n \n", "🙂 🙂🙂", "a" * 300,
]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def random_texts():
    rng = random.Random(5)
    bits = [" ", " ", " ", "Word", "können", "a.", "b,", "\n", "\n", "\t", "  ", "a", "th", "ing", "'s", ".", "é", "ß", "1", "<|", "\x00", " ", "Σ", "́"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(1500)]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("limit", [10**6, 50])
def test_chunks_give_the_ids_of_the_whole_text(name, limit):
    path = tokenizer_file(name)
    tok, enc = Tokenizer.from_file(path), ChunkEncoder(path, limit)
    assert enc.sep is not None
    for texts in (ODD, random_texts(), random_texts()):
        for t, got in zip(texts, enc.encode(texts)):
            assert np.frombuffer(got, enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n, bits in [(0, 4), (1, 4), (2, 4), (3, 2), (16, 4), (40, 6), (300, 12)]:
        counts = np.zeros(n + 3, np.int64)
        counts[1 : n + 1] = rng.zipf(1.3, n).clip(max=10**9)
        got = token_files.code_lengths(counts, bits)
        used = got[got > 0].astype(int)
        assert (got > 0).sum() == n and used.max(initial=0) <= bits
        if n > 1:
            assert sum(2.0**-b for b in used) == 1.0
    counts = np.array([1, 1, 2, 4, 8, 16])
    assert token_files.code_lengths(counts, 10).tolist() == [5, 5, 4, 3, 2, 1]
    assert (token_files.code_lengths(counts, 3) * counts).sum() == 1 * 3 + 1 * 3 + 2 * 3 + 4 * 3 + 8 * 2 + 16 * 2


def test_codebook_round_trip():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.2, 20_000) % 5000).astype(np.uint16)
    book = token_files.Codebook(token_files.code_lengths(np.bincount(ids, minlength=5000), 14))
    for n in (1, 63, 64, 65, 20_000):
        bits, offsets = book.encode(ids[:n])
        assert book.decode(bits, offsets, n).tolist() == ids[:n].tolist()
    one = token_files.Codebook(token_files.code_lengths(np.bincount([3, 3]), 14))
    assert one.decode(*one.encode(np.array([3] * 70)), 70).tolist() == [3] * 70


def expected_ids(df, name, end):
    tok = Tokenizer.from_file(tokenizer_file(name))
    return [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [end]) for r in df.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op5_matches_plain_encoding(spark, sf_dir, documents):
    want, start = set(), 0
    for doc_id, ids in sorted(expected_ids(documents, FILES[0], 2)):
        want.add((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = QUERIES["op5_token_output"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_token_files_keep_odd_rows(spark, docs):
    df = docs((3, None), (3, "b"), (3, "b"), (None, "x"), (None, "y"), (1, ""), (2, "word " * 90_000), *[(10 + i, t) for i, t in enumerate(ODD)])
    folder = token_files.write(df.repartition(3), scratch(spark, "t"), tokenizer_file(FILES[0]))
    rows = token_files.read(spark, folder).orderBy("start").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((i, tuple(x)) for i, x in expected_ids(df, FILES[0], 2))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys)


def test_token_files_of_nothing(spark, docs):
    folder = token_files.write(docs().filter("false"), scratch(spark, "t"), tokenizer_file(FILES[0]))
    assert token_files.read(spark, folder).count() == 0


def check_packing(rows, size):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 20, 64])
    lengths = [rng.choice([size, rng.randint(1, size), 1 + size // 3]) for _ in range(300)]
    rows = []
    for length, runs in packing.plan(Counter(lengths), size).items():
        ranks = []
        for first, n, per, bin_, offset in runs:
            for k in range(n):
                rows.append({"sequence_id": bin_ + k // per, "offset": offset + k % per * length, "length": length})
                ranks.append(first + k)
        assert ranks == list(range(lengths.count(length)))
    assert check_packing(rows, size) == best_fit(lengths, size)


def test_op6_matches_plain_encoding(spark, sf_dir, documents):
    got = QUERIES["op6_best_fit_packing"](spark, sf_dir).collect()
    want = [
        (d, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048]))
        for d, ids in expected_ids(documents, FILES[1], 0)
        for k, at in enumerate(range(0, len(ids), 2048))
    ]
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == Counter(want)
    assert check_packing(got, 2048) == best_fit([w[3] for w in want], 2048)


def test_packing_odd_rows(docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    df = docs(*[(1, "same text")] * 40, (None, "x"), (None, None), (2, "w " * 5000), (3, ""))
    packed = packing.pack(df, tokenizer_file(FILES[1]), 100, 0, with_ids=True)
    rows = packed.collect()
    check_packing(rows, 100)
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in expected_ids(df, FILES[1], 0))
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == r["ends"][-1]
    assert packing.pack(df.filter("false"), tokenizer_file(FILES[1])).count() == 0
