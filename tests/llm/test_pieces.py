import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from tallygrove.llm import pieces
from tallygrove.llm.common import tokenizer_file
from tallygrove.llm.queries import QUERIES

PATH = tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "   a   b   ", "\n x\ty", "日本語 テキスト", "🙂🙂 ok\x00", "é́x", "x" * 100, "the " * 50, "▁a ▁ b"]


@pytest.fixture(scope="module")
def unigram():
    """The library on the same pieces and scores, told to maximise their sum."""
    model = proto.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def voc():
    return pieces.Vocabulary(PATH)


def whole(voc, text):
    """One pass over the whole text."""
    if not text:
        return [], 0
    s = pieces.BLANK + text.replace(" ", pieces.BLANK)
    best, start = voc.forward(s, len(s), (0,))
    return voc.trace(s, start, len(s))[1], best[-1]


def test_scores_match_the_library(voc, unigram, documents):
    """Its lattice (n-best) finds the same greatest sums. Its quick ``encode`` misses the
    greatest sum for a few words in thousands, so ids are compared where the sums agree."""
    words = {w for r in documents.collect() for w in (r["text"] or "").split(" ") if w and all(c in voc.score for c in w)}
    same = 0
    for w in sorted(words)[:3000]:
        ids, score = voc.encode(w)
        best = unigram.nbest_encode_as_ids(w, 2)[0]
        assert sum(voc.score[voc.text[i]][0] for i in best) == score, w
        quick = unigram.encode(w)
        if sum(voc.score[voc.text[i]][0] for i in quick) == score:
            assert quick == ids.tolist(), w
            same += 1
    assert same > 2950
    assert voc.encode("x🙂")[0].tolist() == unigram.encode("x🙂")


def random_text(rng, n):
    return "".join(rng.choices([" ", " ", "the", "in", "a", "e", "é", "\n", "日", "🙂", "stti", "  ", "."], k=n))


def test_words_and_round_trip(voc):
    rng = random.Random(1)
    for text in ODD + [random_text(rng, 40) for _ in range(300)]:
        ids, score = voc.encode(text)
        assert (ids.tolist(), score) == whole(voc, text), repr(text)
        assert voc.decode(ids) == text.replace(pieces.BLANK, " ")


@pytest.mark.parametrize("cuts", [True, False])
def test_chunks_give_the_pieces_of_the_whole(voc, cuts, monkeypatch):
    monkeypatch.setattr(voc, "cuts", cuts)
    rng = random.Random(2)
    for size in (16, 23, 60):
        for text in [random_text(rng, 80) for _ in range(25)] + ["x" * 200, "ab" * 70 + " " * 90, "the" * 60]:
            s = pieces.BLANK + text.replace(" ", pieces.BLANK)
            chunks = [(s[a : a + size + voc.states - 1], min(size, len(s) - a)) for a in range(0, len(s), size)]
            v, entries = np.full(voc.states, pieces.NONE), []
            v[0] = 0
            matrices = [np.array(voc.matrix(*c), np.int64).reshape(voc.states, -1) for c in chunks]
            for m in matrices:
                entries.append(v.tolist())
                v = pieces.combine(v, m)
            state, out = 0, []
            for c, entry in zip(reversed(chunks), reversed(entries)):
                origins, head, tails = voc.traced(*c, entry)
                out = np.frombuffer(head + tails[state], "<u2").tolist() + out
                state = origins[state]
            assert (out, int(v[0])) == whole(voc, text)
            a, b, c = (matrices * 3)[:3]
            assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


def test_op7_covers_all_documents(spark, sf_dir, documents, voc):
    want = set()
    for r in documents.collect():
        ids, score = whole(voc, r["text"] or "")
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        n = max(1, -(-(len(r["text"] or "") + 1) // pieces.CHUNK))
        want.add((r["doc_id"], len(ids), crc, score, n, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op7_sentencepiece"](spark, sf_dir).collect()} == want


def test_large_documents_and_odd_rows(docs, voc):
    rng = random.Random(3)
    rows = [(1, random_text(rng, 3000)), (1, random_text(rng, 2000)), (None, "x" * 3000), (2, None), *[(10 + i, t) for i, t in enumerate(ODD)]]
    got = {(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u2").tolist()), r["score"], r["decoded"]) for r in pieces.encode(docs(*rows), PATH, 500).collect()}
    want = set()
    for i, t in rows:
        ids, score = whole(voc, t or "")
        want.add((i, tuple(ids), score, (t or "").replace(pieces.BLANK, " ")))
    assert got == want
    assert pieces.encode(docs().filter("false"), PATH).count() == 0


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_matrices_are_combined_as_a_tree(spark, voc, fan):
    """Any number of levels gives what one fold over all chunks gives."""
    rng = random.Random(fan)
    rows, want = [], {}
    for key, n in enumerate([1, 2, 3, 4, 9, 23]):
        text = random_text(rng, 30 * n)
        s = pieces.BLANK + text.replace(" ", pieces.BLANK)
        size, v = -(-len(s) // n), np.full(voc.states, pieces.NONE)
        v[0] = 0
        for k, at in enumerate(range(0, len(s), size)):
            m = voc.matrix(s[at : at + size + voc.states - 1], min(size, len(s) - at))
            rows.append((key, k, m))
            want[key, k] = v.tolist()
            v = pieces.combine(v, np.array(m).reshape(voc.states, voc.states))
        want[key, -1] = v.tolist()
    got = pieces._scan(spark.createDataFrame(rows, pieces.MATRIX).repartition(3), fan).collect()
    assert {(r["row_key"], r["k"]): r["v"] for r in got} == want


def test_new_words_are_traced_as_one_by_one(voc):
    rng = random.Random(11)
    words = {pieces.BLANK + random_text(rng, rng.randrange(1, 9)).replace(" ", pieces.BLANK) for _ in range(2000)}
    words |= {pieces.BLANK, pieces.BLANK * 5, pieces.BLANK + "x" * 63, pieces.BLANK + "ab" * 64, "🙂", pieces.BLANK + "日\x00é́本"}
    words = sorted(words)
    for w, got in zip(words, voc.new_words(words)):
        _, start = voc.forward(w, len(w), (0,))
        assert np.frombuffer(got, "<u2").tolist() == voc.trace(w, start, len(w))[1], repr(w)
    assert voc.new_words([]) == [] and voc.learn(["", words[0]])[""] == b""
