"""Benchmark decontamination: phrases of the benchmark found in documents by an FM-index.

Words are maximal runs of digits, a-z (A-Z lowered) and characters beyond ASCII. A phrase
is a window of ten consecutive words of an item; an item of fewer words, but not none, is
one phrase. A document's word is hit if it lies in an occurrence of a phrase.

Method. A task collects documents into shards. Over a shard's words it builds an FM-index:
a suffix array by prefix doubling, the Burrows-Wheeler transform, a wavelet matrix whose
levels hold counts of zeros for ranks, and suffix positions sampled at every 16th place
and where a segment begins. All phrases are searched backwards together, a word a step, an
interval each; those whose interval is empty drop out. Occurrences are located by stepping
back to a sampled place, and their spans merged.

What an index need not hold is left out, exactly: words that no phrase has become
separators; between them, segments shorter than the shortest phrase cannot hold one; equal
segments of a shard are indexed once, with the list of their places. A segment longer than
a shard is cut into pieces that overlap by one word less than the longest phrase.

Phrases are the query set: they are dealt into blocks of bounded count and bytes, and each
block is broadcast and searched in all documents. Which items a phrase comes from is a
join of the phrases found, in Spark. No document's text is moved.

* Null and empty texts have no words. Items of null or no words have no phrase. Items of
  equal item_id are one item; a null item_id is listed as an empty string.
* Rows are told apart by a key of their own; repeated and null doc_ids are kept.
* An empty benchmark hits nothing; an empty table gives no rows. Other columns are not
  carried, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, ship_package, unique_ids

WINDOW = 10
SHARD = 2**18  # words of an index
SAMPLE = 16
BLOCK_PHRASES = 200_000
BLOCK_BYTES = 2**25
BROADCAST_ROWS = 1_000_000
SLICE = 2**20  # bytes split into words at a time

_WORD = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# ---- the index of a shard ----


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; an end comes before every word."""
    n = len(text)
    bits = max(int(text.max()) + 1, 1).bit_length()
    known = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(known):  # the first words of a suffix in one number
        key <<= bits
        if k < n:
            key[: n - k] += text[k:] + 1
    while True:
        order = np.argsort(key)
        ahead = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ahead[1:] != ahead[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - known] += rank[known:] + 1
        known *= 2


class FmIndex:
    """Over words 1..; 0 separates segments, the last word is a separator."""

    def __init__(self, text: np.ndarray):
        n, top = len(text), int(text.max())
        suffixes = suffix_array(text)
        self.bwt = text[suffixes - 1]  # of the first suffix: the separator at the end
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.levels = max(top.bit_length(), 1)
        self.zeros: list[np.ndarray] = []
        row = self.bwt
        for level in range(self.levels):
            bit = (row >> (self.levels - 1 - level)) & 1
            zero = np.zeros(n + 1, np.int32)
            np.cumsum(1 - bit, out=zero[1:])
            self.zeros.append(zero)
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        words = np.arange(top + 1)
        self.first = self._down(words, np.zeros(top + 1, np.int64))
        sampled = (suffixes % SAMPLE == 0) | (self.bwt == 0)
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.places = suffixes[sampled]
        self.top = top

    def _down(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places in the last level, where equal words stand together."""
        for level, zero in enumerate(self.zeros):
            zeros = zero[at]
            one = (words >> (self.levels - 1 - level)) & 1
            at = np.where(one == 1, zero[-1] + at - zeros, zeros)
        return at

    def rank(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each word occurs before a place of the transform."""
        return self._down(words, at) - self.first[words]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end) of the phrases that occur. Phrases end in the last column."""
        which = np.flatnonzero((phrases[:, -1] <= self.top) & (lengths > 0))
        last = phrases[which, -1]
        low, high = self.before[last], self.before[last + 1]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(1, phrases.shape[1] + 1):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            done = lengths[which] == step
            out.append((which[done], low[done], high[done]))
            which, low, high = which[~done], low[~done], high[~done]
            if not len(which):
                break
            word = phrases[which, -1 - step]
            inside = word <= self.top
            which, low, high, word = which[inside], low[inside], high[inside], word[inside]
            low, high = (self.before[word] + self.rank(word, x) for x in (low, high))
        return tuple(np.concatenate(x) for x in zip(*out))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the transform."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            known = self.sampled[here + 1] > self.sampled[here]
            out[todo[known]] = self.places[self.sampled[here[known]]] + steps[todo[known]]
            todo, here = todo[~known], here[~known]
            word = self.bwt[here]
            at[todo] = self.before[word] + self.rank(word, here)
            steps[todo] += 1
        return out


# ---- tasks ----


def word_ids(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words, 0 for those outside the vocabulary. Long texts are split slice by slice."""
    data, out, at = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS), [], 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        out.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class Phrases:
    """A block of the query set: phrases as rows of word numbers, flush right."""

    def __init__(self, phrases: list[str]):
        split = [p.encode().split(b" ") for p in phrases]
        self.vocabulary: dict[bytes, int] = {}
        for words in split:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.lengths = np.array([len(w) for w in split], np.int64)
        self.longest, self.shortest = int(self.lengths.max()), int(self.lengths.min())
        self.rows = np.zeros((len(split), self.longest), np.int64)
        for i, words in enumerate(split):
            self.rows[i, self.longest - len(words) :] = [self.vocabulary[w] for w in words]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_shard(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """(merged spans of words, phrases found) of each document."""
    segments: dict[bytes, list[tuple[int, int]]] = {}
    for d, ids in enumerate(docs):
        edges = np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8))
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = stops - starts >= phrases.shortest
        for a, b in zip(starts[long].tolist(), stops[long].tolist()):
            for piece in range(a, max(a + 1, b - phrases.longest + 1), SHARD - phrases.longest + 1):
                segments.setdefault(ids[piece : min(b, piece + SHARD)].tobytes(), []).append((d, piece))
    found: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in docs]
    held: list[bytes] = []
    words = 0
    for s in [*segments, b""]:
        if held and (not s or words + len(s) // 4 > SHARD):
            _search(held, segments, phrases, found)
            held, words = [], 0
        if s:
            held.append(s)
            words += len(s) // 4 + 1
    return [(merge(spans), sorted(which)) for spans, which in found]


def _search(held: list[bytes], segments: dict, phrases: Phrases, found: list) -> None:
    """One index over the segments held; its hits go to all their places."""
    zero = bytes(4)
    index = FmIndex(np.frombuffer(zero.join(held) + zero, np.int32).astype(np.int64))
    which, low, high = index.search(phrases.rows, phrases.lengths)
    count = high - low
    if not count.sum():
        return
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, which = index.locate(rows), np.repeat(which, count)
    begins = np.concatenate(([0], np.cumsum([len(s) // 4 + 1 for s in held])))
    segment = np.searchsorted(begins, at, "right") - 1
    order = np.lexsort((at, segment))
    at, which, segment = at[order], which[order], segment[order]
    cuts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True])))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        start = at[i:j] - begins[segment[i]]
        spans = merge(list(zip(start.tolist(), (start + phrases.lengths[which[i:j]]).tolist())))
        kinds = set(which[i:j].tolist())
        for d, a in segments[held[segment[i]]]:
            found[d][0].extend((a + x, a + y) for x, y in spans)
            found[d][1].update(kinds)


def character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points."""
    out, at, words = [], 0, re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text)
    for a, b in spans:
        for _ in range(at, a):
            next(words)
        first = last = next(words)
        for _ in range(a + 1, b):
            last = next(words)
        at = b
        out.append((first.start(), last.end()))
    return out


_SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in ("word", "word_end", "start", "stop")]))
_SPANS_SQL = "array<struct<word:bigint,word_end:bigint,start:bigint,stop:bigint>>"
_FOUND = f"row_key bigint, doc_id bigint, n_words bigint, spans {_SPANS_SQL}, phrases array<int>"


def _searched(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases: Phrases = shared.value
    keys, ids, texts, docs, words = [], [], [], [], 0

    def shard() -> pa.RecordBatch:
        found = search_shard(docs, phrases)
        spans = [
            [{"word": a, "word_end": b, "start": c, "stop": d} for (a, b), (c, d) in zip(s, character_spans(t, s) if s else [])]
            for t, (s, _) in zip(texts, found)
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(d) for d in docs], pa.int64()),
                pa.array(spans, _SPANS), pa.array([p for _, p in found], pa.list_(pa.int32())),
            ],
            ["row_key", "doc_id", "n_words", "spans", "phrases"],
        )

    for b in batches:
        for key, i, text in zip(*(b.column(c) for c in ("row_key", "doc_id", "text"))):
            text = text.as_py() or ""
            keys.append(key.as_py())
            ids.append(i.as_py())
            texts.append(text)
            docs.append(word_ids(text, phrases.vocabulary))
            words += len(docs[-1])
            if words >= SHARD:
                yield shard()
                keys, ids, texts, docs, words = [], [], [], [], 0
    if docs:
        yield shard()


# ---- Spark ----


def benchmark_phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, item): the distinct phrases of each item, words joined by blanks."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.array_remove(F.split(low, _NOT_WORD), "").alias("w")
    ).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    starts = split.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return starts.select(F.array_join(F.slice("w", F.col("i") + 1, window), " ").alias("phrase"), "item").distinct()


def _merged(spans: Column) -> Column:
    """Spans of several blocks, overlapping and touching ones as one."""

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = s["word_end"] > last["word_end"]
        both = F.struct(
            last["word"].alias("word"), F.when(longer, s["word_end"]).otherwise(last["word_end"]).alias("word_end"),
            last["start"].alias("start"), F.when(longer, s["stop"]).otherwise(last["stop"]).alias("stop"),
        )
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))
        return F.when((F.size(acc) > 0) & (s["word"] <= last["word_end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS_SQL), add)


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) per document: merged spans of hit words, by words (word,
    word_end) and by code points (start, stop), ends exclusive, and the sorted ids of items with
    phrases in it."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = unique_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    of_items = cut(benchmark_phrases(items, window), "phrase-items")
    phrases = of_items.select("phrase").distinct()
    count, size = phrases.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_PHRASES), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("phrase"), F.lit(blocks))
    names = cut(phrases.select("phrase", block.alias("block")), "phrases")
    found, numbers = [], []
    for k in range(blocks):
        texts = sorted(r["phrase"] for r in names.filter(F.col("block") == k).select("phrase").collect()) or [" "]
        shared = spark.sparkContext.broadcast(Phrases(texts))
        one = docs.select("row_key", "doc_id", "text").mapInArrow(partial(_searched, shared), _FOUND)
        found.append(cut(one.withColumn("block", F.lit(k)), "phrases-found"))
        number = F.broadcast(spark.createDataFrame(list(enumerate(texts)), "number int, name string"))
        numbers.append(of_items.join(number, F.col("phrase") == F.col("name")).select(F.lit(k).alias("block"), "number", "item"))
    everything, sources = found[0], numbers[0]
    for f, n in zip(found[1:], numbers[1:]):
        everything, sources = everything.unionAll(f), sources.unionAll(n)
    sources = cut(sources, "phrase-sources")
    hits = everything.filter(F.size("phrases") > 0)
    pairs = hits.select("row_key", "block", F.explode("phrases").alias("number"))
    few = sources.count() <= BROADCAST_ROWS
    listed = pairs.join(F.broadcast(sources) if few else sources, ["block", "number"]).select("row_key", "item").distinct()
    listed = listed.groupBy("row_key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    none = F.array().cast("array<string>")
    columns = ["doc_id", "n_words", "spans", "item_ids"]
    if blocks == 1:
        dirty, clean = hits, everything.filter(F.size("phrases") == 0)
    else:
        together = F.collect_list("spans").alias("spans")
        dirty = hits.groupBy("row_key", "doc_id", "n_words").agg(together).withColumn("spans", _merged(F.flatten("spans")))
        clean = found[0].join(hits.select("row_key").distinct(), "row_key", "left_anti")
    return dirty.join(listed, "row_key").select(columns).unionAll(clean.withColumn("item_ids", none).select(columns))


def remove(text: Column, spans: Column) -> Column:
    """The text without its spans."""
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["stop"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(kept, "")
