"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text's pieces are the ones with the greatest sum of scores (Viterbi over the model's
vocabulary, unknown characters as bytes). Between two words every segmentation has
a cut, so a word's pieces are found once per worker and remembered.

Documents above ``CHUNK`` characters are split at fixed places, wherever those fall.
A piece may reach over a place by 0 to 15 characters: those are the states. Each chunk yields a
matrix of best scores from entry to exit state; matrices combine by (max, +), which is
associative, and give every chunk the scores of its entries. Knowing those, each chunk
traces its pieces back on its own for each exit state, and the chain of states from
the end picks one. Ties are resolved as in one pass from left to right: the
longest last piece. Scores are added as integers, so chunks change nothing.

The result is the best segmentation of a model of the unigram kind with these pieces and scores, the one
the library's lattice finds. For a file of the BPE kind the library itself merges pairs
instead, which no sum of scores expresses.

Null texts count as empty and have no pieces. Repeated rows and ids, and null ids, are rows of
their own. An empty table gives no rows. Columns other than id and text are not carried. A
U+2581 in a text is a blank to this format and comes back as one.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, texts, unique_ids

CHUNK = 32_768
REMEMBERED = 500_000
PLACES = 64  # longer words are traced one by one
BLANK = "▁"
NONE = -(1 << 60)
_UNKNOWN_PENALTY = 10


class Trie:
    """The pieces by their characters, as arrays: many places are followed at once."""

    def __init__(self, score: dict[str, tuple[int, int]]):
        self.letter = {c: i for i, c in enumerate(sorted({c for p in score for c in p}), 1)}
        self.top = max(map(ord, self.letter), default=0) + 1
        self.code = np.zeros(self.top + 1, np.int64)  # 0: in no piece
        for c, i in self.letter.items():
            self.code[ord(c)] = i
        nodes, edges = {"": 0}, []
        for p in sorted(score):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    edges.append((nodes[p[: k - 1]] * (len(self.letter) + 1) + self.letter[p[k - 1]], len(nodes)))
                    nodes[p[:k]] = len(nodes)
        self.piece = np.full(len(nodes), -1, np.int64)
        self.score = np.zeros(len(nodes), np.int64)
        for p, (value, i) in score.items():
            self.piece[nodes[p]], self.score[nodes[p]] = i, value
        self.bits = max(10, (4 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        keys, children = (np.array(x, np.int64) for x in (zip(*edges) if edges else ([], [])))
        at = self._home(keys)
        while len(keys):  # each takes its place or, where that is taken, the one behind it
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            placed = np.zeros(len(keys), bool)
            placed[first] = True
            placed &= free
            self.keys[at[placed]], self.next[at[placed]] = keys[placed], children[placed]
            keys, children, at = keys[~placed], children[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node behind each node by a character; 0 where there is none."""
        keys = node * (len(self.letter) + 1) + code
        at, out, todo = self._home(keys), np.zeros(len(keys), np.int64), np.flatnonzero(code)
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.next[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """Pieces, scores and the words seen so far."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.text = [p.piece for p in model.pieces]
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        if any(p.score != int(p.score) for _, p in normal):
            raise ValueError("scores must be whole numbers, so that sums are exact")
        self.score = {p.piece: (int(p.score), i) for i, p in normal}
        self.unknown = min(int(p.score) for _, p in normal) - _UNKNOWN_PENALTY
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.states = max(len(p.piece) for _, p in normal)
        self.prefixes = {p.piece[:k] for _, p in normal for k in range(1, len(p.piece) + 1)}
        # No piece goes on into the next word, other than pieces of blanks alone.
        self.cuts = not any(BLANK in p.piece[1:] and p.piece.strip(BLANK) for _, p in normal)
        self.known: dict[str, bytes] = {}  # ids only: scores follow from them
        self.trie = Trie(self.score)
        # An unknown character is charged once, with its first byte.
        first = [b < 0x80 or b >= 0xC0 for b in range(256)]
        charge = {i: self.unknown if first[b] else 0 for b, i in self.byte.items()}
        scores = {i: s for s, i in self.score.values()} | charge
        self.id_score = np.array([scores.get(i, 0) for i in range(len(self.text))], np.int64)
        self.raw = [p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])

    def forward(self, s: str, n: int, entry: Sequence[int]) -> tuple[list[int], list[int]]:
        """Best scores up to each place and where its last piece starts (-1: before
        ``s``). Pieces start before ``n`` and end anywhere in ``s``."""
        size = len(s)
        best, start = [NONE] * (size + 1), [-1] * (size + 1)
        for e, value in enumerate(entry[: size + 1]):
            best[e] = value
        score, prefixes, longest = self.score, self.prefixes, self.states
        for i in range(n):
            here = best[i]
            if here <= NONE:
                continue
            single = False
            for j in range(i + 1, min(i + longest, size) + 1):
                piece = s[i:j]
                if piece not in prefixes:
                    break
                hit = score.get(piece)
                if hit is not None:
                    single = single or j == i + 1
                    if here + hit[0] > best[j]:
                        best[j], start[j] = here + hit[0], i
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], start[i + 1] = here + self.unknown, i
        return best, start

    def trace(self, s: str, start: Sequence[int], end: int, stop: int = 0) -> tuple[int, list[int]]:
        """Where the path to ``end`` begins (at ``stop``, or before ``s``), and its ids."""
        out: list[int] = []
        while end > stop and start[end] >= 0:
            piece = s[start[end] : end]
            hit = self.score.get(piece)
            out += [hit[1]] if hit is not None else [self.byte[b] for b in reversed(piece.encode())]
            end = start[end]
        return end, out[::-1]

    def word(self, s: str) -> bytes:
        got = self.known.get(s)
        if got is None:
            _, start = self.forward(s, len(s), (0,))
            got = np.array(self.trace(s, start, len(s))[1], "<u2").tobytes()
            if len(self.known) < REMEMBERED:
                self.known[s] = got
        return got

    def new_words(self, words: Sequence[str]) -> list[bytes]:
        """Ids of words, the best paths of all of them found together: arrays over the places of all
        words, a step per place and length of a piece."""
        plain = [w for w in words if 0 < len(w) <= PLACES]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        begin = np.cumsum(sizes + 1) - sizes - 1  # each word has a place more than characters
        letters = np.frombuffer("\0".join([*plain, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        code = self.trie.code[np.minimum(letters, self.trie.top)]
        code[begin + sizes] = 0
        inside = np.arange(len(code)) - np.repeat(begin, sizes + 1)
        # Pieces that start at each place: by their length, places and nodes.
        arcs, at, node = [], np.flatnonzero(code), None
        node = np.zeros(len(at), np.int64)
        for k in range(self.states):
            node = self.trie.step(node, code[at + k])
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            hit = self.trie.piece[node] >= 0
            by = np.argsort(inside[at[hit]], kind="stable")
            places, ends = at[hit][by], node[hit][by]
            arcs.append((places, ends, np.searchsorted(inside[places], np.arange(int(sizes.max(initial=0)) + 1))))
        single = np.zeros(len(code), bool)
        if arcs:
            single[arcs[0][0]] = True
        best, start = np.full(len(code), NONE), np.full(len(code), -1, np.int64)
        taken = np.full(len(code), -1, np.int64)  # the piece that ends at a place
        best[begin] = 0
        lengths = np.sort(sizes)
        by_size = begin[np.argsort(sizes, kind="stable")]
        for i in range(int(sizes.max(initial=0))):
            for k, (places, ends, cuts) in enumerate(arcs, 1):
                p, e = places[cuts[i] : cuts[i + 1]], ends[cuts[i] : cuts[i + 1]]
                if len(p):
                    value = best[p] + self.trie.score[e]
                    better = value > best[p + k]
                    p, to = p[better], p[better] + k
                    best[to], start[to], taken[to] = value[better], p, self.trie.piece[e[better]]
            here = by_size[np.searchsorted(lengths, i, "right") :] + i
            here = here[~single[here]]
            if len(here):
                value = best[here] + self.unknown
                better = value > best[here + 1]
                to = here[better] + 1
                best[to], start[to], taken[to] = value[better], here[better], -1
        # Back from the ends of all words together.
        at, word, ids, owners, places = begin + sizes, np.arange(len(plain)), [], [], []
        while len(at):
            ids.append(taken[at])
            owners.append(word)
            at = start[at]
            places.append(at)
            live = at > begin[word]
            at, word = at[live], word[live]
        if not ids:
            return [self.word(w) for w in words]
        owner, step = np.concatenate(owners), np.concatenate([np.full(len(o), -k) for k, o in enumerate(owners)])
        order = np.lexsort((step, owner))
        piece, place = np.concatenate(ids)[order], np.concatenate(places)[order]
        flat = piece.astype("<u2").tobytes()
        cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(plain)))))
        found = dict(zip(plain, [flat[2 * a : 2 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]))
        unknown = np.flatnonzero(piece < 0)
        spelled: dict[int, list[bytes]] = {}  # words with unknown characters, which are bytes
        for k, i, c in zip(unknown.tolist(), owner[order][unknown].tolist(), letters[place[unknown]].tolist()):
            parts = spelled.get(i)
            if parts is None:
                first, last = int(cuts[i]), int(cuts[i + 1])
                parts = spelled[i] = [flat[2 * j : 2 * j + 2] for j in range(first, last)]
            parts[k - int(cuts[i])] = self._bytes_of(c)
        for i, parts in spelled.items():
            found[plain[i]] = b"".join(parts)
        return [found[w] if w in found else self.word(w) for w in words]

    @functools.lru_cache(maxsize=10_000)  # noqa: B019 (one vocabulary lives as long as its worker)
    def _bytes_of(self, letter: int) -> bytes:
        """Ids of the bytes of an unknown character."""
        return np.array([self.byte[b] for b in chr(letter).encode()], "<u2").tobytes()

    def learn(self, words: Sequence[str]) -> dict[str, bytes]:
        """Ids of the distinct words among these, remembered ones and new ones."""
        here, missing, get = {}, [], self.known.get
        for w in set(words):
            ids = get(w)
            if ids is None:
                missing.append(w)
            else:
                here[w] = ids
        if missing:
            new = dict(zip(missing, self.new_words(missing)))
            here.update(new)
            if len(self.known) + len(new) <= REMEMBERED:
                self.known.update(new)
        return here

    @staticmethod
    def split(s: str) -> list[str]:
        """Words of a stretch that starts with a blank; each has its blank, and blanks in a row go with
        the word behind them."""
        parts = s[1:].split(BLANK)
        if "" in parts:
            merged, lead = [], ""
            for p in parts[:-1]:
                if p:
                    merged.append(lead + p)
                lead = "" if p else lead + BLANK
            parts = [*merged, lead + parts[-1]]
        return [BLANK + p for p in parts]

    def words(self, s: str) -> tuple[bytes, int]:
        """Ids and score of a stretch that starts with a blank and ends where a word does."""
        parts = self.split(s)
        ids = b"".join(map(self.learn(parts).__getitem__, parts))
        return ids, int(self.id_score[np.frombuffer(ids, "<u2")].sum())

    def encode_all(self, texts: Sequence[str]) -> list[tuple[np.ndarray, int]]:
        """Ids and score of several texts, whose new words are looked for together."""
        if not self.cuts:
            return [self.encode(t) for t in texts]
        split = [self.split(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        get = self.learn([w for parts in split for w in parts]).__getitem__
        found = [np.frombuffer(b"".join(map(get, parts)), "<u2") for parts in split]
        return [(ids, int(self.id_score[ids].sum())) for ids in found]

    def encode(self, text: str) -> tuple[np.ndarray, int]:
        """Ids and score of a whole text."""
        if not text:
            return np.zeros(0, "<u2"), 0
        s = BLANK + text.replace(" ", BLANK)
        if self.cuts:
            ids, score = self.words(s)
            return np.frombuffer(ids, "<u2"), score
        best, start = self.forward(s, len(s), (0,))
        return np.array(self.trace(s, start, len(s))[1], "<u2"), best[-1]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out.removeprefix(" ")

    def middle(self, s: str, n: int) -> tuple[int, int] | None:
        """First and last place inside a chunk that every segmentation cuts at."""
        if not self.cuts:
            return None
        first = next((p for p in self._starts(s, 1, n, 1)), None)
        return None if first is None else (first, next(p for p in self._starts(s, n - 1, 0, -1)))

    @staticmethod
    def _starts(s: str, a: int, b: int, step: int) -> Iterator[int]:
        for p in range(a, b, step):
            if s[p] == BLANK and s[p - 1] != BLANK:
                yield p

    def matrix(self, s: str, n: int) -> list[int]:
        """Best scores from entry to exit state, row by row."""
        w, tail = self.states, len(s) - n
        out = [NONE] * (w * w)
        mid = self.middle(s, n)
        if mid is None:
            for e in range(min(w, n + 1)):
                best, _ = self.forward(s, n, [NONE] * e + [0])
                out[e * w : e * w + tail + 1] = best[n:]
            return out
        first, last = mid
        inner = self.words(s[first:last])[1] if last > first else 0
        exits, _ = self.forward(s[last:], n - last, (0,))
        for e in range(min(w, first + 1)):
            best, _ = self.forward(s[:first], first, [NONE] * e + [0])
            if best[first] > NONE:
                for x in range(tail + 1):
                    if exits[n - last + x] > NONE:
                        out[e * w + x] = best[first] + inner + exits[n - last + x]
        return out

    def traced(self, s: str, n: int, entry: Sequence[int]) -> tuple[list[int], bytes, list[bytes]]:
        """Per exit state the entry state it comes from; the ids all exits share and each one's further ids."""
        w, tail = self.states, len(s) - n
        mid = self.middle(s, n)
        if mid is None:
            best, start = self.forward(s, n, entry)
            ways = [self.trace(s, start, n + x) if x <= tail and best[n + x] > NONE else (-1, []) for x in range(w)]
            return [e for e, _ in ways], b"", [np.array(i, "<u2").tobytes() for _, i in ways]
        first, last = mid
        _, start = self.forward(s[:first], first, entry)
        origin, head = self.trace(s[:first], start, first)
        inner = self.words(s[first:last])[0] if last > first else b""
        best, start = self.forward(s[last:], n - last, (0,))
        ways = [self.trace(s[last:], start, n - last + x)[1] if x <= tail and best[n - last + x] > NONE else None for x in range(w)]
        tails = [np.array(i or [], "<u2").tobytes() for i in ways]
        return [origin if i is not None else -1 for i in ways], np.array(head, "<u2").tobytes() + inner, tails


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    return Vocabulary(path)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product of two matrices, or of a vector and a matrix."""
    return np.maximum((a[..., :, None] + b).max(axis=-2), NONE)


ENCODED = "row_key bigint, doc_id bigint, ids binary, score bigint, n_chunks int, decoded string"
DIGESTS = "row_key bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, score bigint, n_chunks int, decoded_sha256 string"


def _row(voc: Vocabulary, key: int, doc_id: int | None, ids: bytes, score: int, chunks: int) -> tuple:
    return key, doc_id, ids, score, chunks, voc.decode(np.frombuffer(ids, "<u2"))


def _digest(voc: Vocabulary, key: int, doc_id: int | None, ids: bytes, score: int, chunks: int) -> tuple:
    """What :func:`_row` gives, as number of ids, checksum of them and digest of the decoded text."""
    numbers = np.frombuffer(ids, "<u2")
    decoded = hashlib.sha256(voc.decode(numbers).encode()).hexdigest()
    return key, doc_id, len(numbers), zlib.crc32(numbers.astype("<u4").tobytes()), score, chunks, decoded


ROWS = {ENCODED: _row, DIGESTS: _digest}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _small(docs: DataFrame, path: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys, doc_ids, found = (part.column(c).to_pylist() for c in ("row_key", "doc_id", "text"))
                rows = zip(keys, doc_ids, voc.encode_all(found))
                yield _batch([ROWS[schema](voc, key, doc_id, ids.tobytes(), score, 1) for key, doc_id, (ids, score) in rows], schema)

    return docs.mapInArrow(run, schema)


def _chunks(docs: DataFrame, path: str, size: int) -> DataFrame:
    """(row_key, doc_id, k, n, s) of each chunk, with the characters that pieces may reach."""
    schema = "row_key bigint, doc_id bigint, k int, n int, s string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = vocabulary(path).states - 1
        for b in batches:
            for key, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("row_key", "doc_id", "text"))):
                s = BLANK + text.replace(" ", BLANK)
                for k, at in enumerate(range(0, len(s), size)):
                    yield _batch([(key, doc_id, k, min(size, len(s) - at), s[at : at + size + more])], schema)

    return docs.mapInArrow(run, schema)


MATRIX = "row_key bigint, k int, m array<bigint>"
VECTOR = "row_key bigint, k int, v array<bigint>"
FAN = 64  # matrices that one group combines


def _square(values: list[int]) -> np.ndarray:
    w = int(len(values) ** 0.5)
    return np.array(values, np.int64).reshape(w, w)


def _product(fan: int, table: pa.Table) -> pa.Table:
    """The product of a group's matrices, as the matrix of the group."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    m = functools.reduce(combine, [_square(r["m"]) for r in rows])
    return pa.Table.from_batches([_batch([(rows[0]["row_key"], rows[0]["k"] // fan, m.ravel().tolist())], MATRIX)])


def _entered(rows: list[dict], v: np.ndarray, end: bool) -> pa.Table:
    """Scores of the entry states of each chunk or group, from those of the first; behind the last
    one as number -1."""
    out = []
    for r in sorted(rows, key=lambda r: r["k"]):
        out.append((r["row_key"], r["k"], v.tolist()))
        v = combine(v, _square(r["m"]))
    if end:
        out.append((rows[0]["row_key"], -1, v.tolist()))
    return pa.Table.from_batches([_batch(out, VECTOR)])


def _scan(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """Entry scores (row_key, k, v) of every chunk, and the document's final scores (k = -1): matrices
    are combined by ``fan``, level by level, until a document has ``fan`` at most; from there the scores
    go down again. No group holds more than ``fan`` matrices."""
    levels = [matrices]
    most = matrices.agg(F.max("k")).first()[0] or 0
    while most >= fan:
        up = levels[-1].groupBy("row_key", F.floor(F.col("k") / fan).alias("p")).applyInArrow(lambda table: _product(fan, table), MATRIX)
        levels.append(cut(up, "matrices"))
        most //= fan

    def top(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = np.full(int(len(rows[0]["m"]) ** 0.5), NONE)
        first[0] = 0
        return _entered(rows, first, True)

    def down(group: pa.Table, parent: pa.Table) -> pa.Table:
        return _entered(group.to_pylist(), np.array(parent.column("v")[0].as_py(), np.int64), False)

    entries = cut(levels[-1].groupBy("row_key").applyInArrow(top, VECTOR), "entries")
    ends = entries.filter("k < 0")
    for level in reversed(levels[:-1]):
        children = level.withColumn("p", F.floor(F.col("k") / fan)).groupBy("row_key", "p")
        parents = entries.filter("k >= 0").withColumn("p", F.col("k").cast("bigint")).groupBy("row_key", "p")
        entries = cut(children.cogroup(parents).applyInArrow(down, VECTOR), "entries")
    return entries if len(levels) == 1 else entries.unionByName(ends)


def _large(docs: DataFrame, path: str, size: int, schema: str) -> DataFrame:
    """Documents of several chunks. Groups hold FAN matrices, or the ids of one document, which are one value."""
    chunks = cut(_chunks(docs, path, size).repartition("row_key", "k"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            for key, k, n, s in zip(*(b.column(c).to_pylist() for c in ("row_key", "k", "n", "s"))):
                yield _batch([(key, k, voc.matrix(s, n))], "row_key bigint, k int, m array<bigint>")

    own = chunks.select("row_key", "k", "n", "s").mapInArrow(matrices, MATRIX)
    entries = _scan(cut(own, "matrices"))
    traced = "row_key bigint, doc_id bigint, k int, origins array<bigint>, head binary, tails array<binary>, score bigint"

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            for key, doc_id, k, n, s, v, score in zip(*(b.column(c).to_pylist() for c in ("row_key", "doc_id", "k", "n", "s", "v", "score"))):
                yield _batch([(key, doc_id, k, *voc.traced(s, n, v), score)], traced)

    def chain(table: pa.Table) -> pa.Table:
        voc, state, parts = vocabulary(path), 0, []
        rows = sorted(table.to_pylist(), key=lambda r: -r["k"])
        for r in rows:
            parts.append(r["head"] + r["tails"][state])
            state = r["origins"][state]
        row = ROWS[schema](voc, rows[0]["row_key"], rows[0]["doc_id"], b"".join(reversed(parts)), rows[0]["score"], len(rows))
        return pa.Table.from_batches([_batch([row], schema)])

    ends = entries.filter("k < 0").select("row_key", F.col("v")[0].alias("score"))
    known = chunks.join(entries, ["row_key", "k"]).join(ends, "row_key")
    return known.mapInArrow(trace, traced).groupBy("row_key").applyInArrow(chain, schema)


def _encoded(df: DataFrame, model_path: str, chunk: int, schema: str) -> DataFrame:
    docs = unique_ids(texts(df)).select("row_key", "doc_id", "text")
    size = F.length("text") + 1
    small = _small(docs.filter(size <= chunk), model_path, schema)
    large = _large(docs.filter(size > chunk), model_path, chunk, schema)
    return small.unionByName(large).drop("row_key")


def encode(df: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (little-endian 16 bit), score, n_chunks and the text decoded from the ids, of every row."""
    return _encoded(df, model_path, chunk, ENCODED)


def digests(df: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers), score, n_chunks and
    decoded_sha256 of every row: what :func:`encode` gives, of which only the digests leave a task."""
    return _encoded(df, model_path, chunk, DIGESTS)
