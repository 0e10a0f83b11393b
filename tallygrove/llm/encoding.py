"""Token ids of whole texts, with a cache of text chunks in each Python worker.

A text is cut at single blanks where no token can cross, each chunk is encoded
once by the tokenizer and remembered, and the ids of the text are the chunks'
ids in order. Of chunks that are not remembered yet, plain words go to the
tokenizer's model one by one and others through the whole tokenizer, many at once, between
separators whose id cannot merge with anything. The result is the tokenizer's own
for the whole text; the cache changes the time only.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallygrove.llm.common import tokenizer

# Chunks remembered per worker, about 200 bytes each. Later ones are encoded
# whenever they come.
REMEMBERED = 400_000
BYTES_AT_ONCE = 4 << 20
SEGMENT = 8 << 20  # characters of a longer text that are split together

_AFTER_BLANK = re.compile(r" (?:\s|\Z)")
_SEPARATOR = "\x00"
_MARKS = ".,;:!?"
_PARTS = re.compile(r"([.,;:!?]+|\n)")
_LATIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies show each byte as one letter: printable Latin-1
    bytes as themselves, the others as letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()
_BLANK = _BYTE_LETTERS[ord(" ")]


class ChunkEncoder:
    """``words`` tokenizers drop white space, so every blank ends a chunk and
    belongs to none. Others keep a blank with the word behind it."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        self.tok = tokenizer(path)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words = len(self.tok.encode("a b", add_special_tokens=False).ids) == 2 and self.ids("a ") == self.ids("a")
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.model, self.code = self.tok.model, {2: "H", 4: "I"}[self.dtype.itemsize]
        # Letters of Latin script keep their accents, or this is not used for them.
        letters = [c for c in map(chr, range(0xAA, ord(_LATIN_END))) if c.isalpha() and c != "\u0130"]
        self.latin = all(self._word(c, False) == np.array(self.ids(c), self.dtype).tobytes() for c in letters)
        sep = self.ids(_SEPARATOR)
        mark = self.tok.id_to_token(sep[0]) if len(sep) == 1 else None
        mixed = mark is None or not self.words and any(mark in t and t.strip(mark) for t in self.tok.get_vocab())
        self.sep = None if mixed else sep[0]

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _chunks(self, text: str) -> list[str]:
        """Keys of the chunks: the text behind a blank; the first one, which has
        no blank before it, is marked by one."""
        parts = text.split(" ")
        if self.words:
            return parts
        if _AFTER_BLANK.search(text):
            merged = parts[:1]
            for p in parts[1:]:
                if not p or p[0].isspace():
                    merged[-1] += " " + p
                else:
                    merged.append(p)
            parts = merged
        parts[0] = " " + parts[0]
        return parts

    def _text(self, key: str) -> str:
        return key if self.words else key[1:] if key[:1] == " " else " " + key

    def _plain(self, word: str) -> bool:
        """Letters that the tokenizer takes as they are, but for their case."""
        if not word.isalpha():
            return False
        return not self.words or word.isascii() or self.latin and max(word) < _LATIN_END and "\u0130" not in word

    def _word(self, letters: str, blank: bool) -> bytes:
        """Ids of one pre-token of letters or of punctuation."""
        piece = letters.lower() if self.words else letters
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        if blank and not self.words:
            piece = _BLANK + piece
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _tail(self, marks: str) -> bytes:
        """Ids of punctuation behind a word."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._word(marks, False)
            if len(self.tails) < 10_000:
                self.tails[marks] = ids
        return ids

    def _simple(self, key: str, new: dict[str, bytes]) -> bytes | None:
        """Ids of words with punctuation and line breaks between them, where the
        pre-tokens are plain to see; else None."""
        parts = [p for p in _PARTS.split(key) if p]
        plain = [p for p in parts if self._plain(p)]
        if not parts or parts[0] is not (plain or [None])[0] or parts[-1] == "\n":
            return None
        if len(plain) + sum(_PARTS.fullmatch(p) is not None for p in parts) != len(parts) or "\n\n" in key:
            return None
        out = b""
        for i, p in enumerate(parts):
            k = p if i == 0 else f" {p}"  # as the first chunk of a text: no blank before it
            ids = self.known.get(k) or new.get(k)
            if ids is None:
                if p == "\n":
                    ids = b"" if self.words else np.array(self.ids(p), self.dtype).tobytes()
                else:
                    ids = self._word(p, i == 0)
                if not self.words:
                    new[k] = ids
            out += ids
        return out

    def _encode_new(self, keys: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        together = []
        plain, known, word, tails = self._plain, self.known.get, self._word, self.tails
        for k in keys:
            # Nearly all are a word, with punctuation behind it or not.
            stem = k.rstrip(_MARKS)
            if plain(stem):
                size = len(stem)
                if size == len(k):
                    out[k] = word(k, True)
                else:
                    marks = k[size:]
                    out[k] = (known(stem) or word(stem, True)) + (tails.get(marks) or self._tail(marks))
                continue
            ids, t = self._simple(k, out), self._text(k)
            if ids is not None:
                out[k] = ids
            elif not t:
                out[k] = b""
            elif self.sep is None or _SEPARATOR in t or "<|" in t or not self.words and (t[-1].isspace() or t[0] == "'"):
                out[k] = np.array(self.ids(t), self.dtype).tobytes()
            else:
                together.append((k, t))
        glue = f" {_SEPARATOR} " if self.words else _SEPARATOR
        for at in range(0, len(together), 2000):
            part = together[at : at + 2000]
            joined = glue.join(t for _, t in part)
            ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.sep), len(ids))
            if len(ends) != len(part):
                raise ValueError("separators were merged into tokens")
            start = 0
            for (k, _), end in zip(part, ends.tolist()):
                out[k] = ids[start:end].tobytes()
                start = end + 1
        return out

    def _ids_of(self, keys: Sequence[str]) -> list[bytes]:
        """Ids of distinct chunks, remembered ones and new ones."""
        out = list(map(self.known.get, keys))
        missing = [k for k, ids in zip(keys, out) if ids is None]
        if missing:
            new = self._encode_new(missing)
            if len(self.known) + len(new) <= self.limit:
                self.known.update(new)
            out = [new[k] if ids is None else ids for k, ids in zip(keys, out)]
        return out

    def _segments(self, text: str) -> list[str] | None:
        """A long text in pieces, cut at single blanks; None where a text has blanks that go with the
        white space behind them."""
        if not self.words and _AFTER_BLANK.search(text):
            return None
        out, at = [], 0
        while len(text) - at > SEGMENT and (end := text.find(" ", at + SEGMENT)) >= 0:
            out.append(text[at:end])
            at = end + 1
        return [*out, text[at:]]

    def encode_flat(self, batch: Sequence[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's followed by ``end`` if that is given, and the
        number of ids of each. Chunks are split and numbered by Arrow; only the distinct ones of the
        batch are looked up."""
        rows, firsts, texts, odd = [], [], [], {}
        for i, t in enumerate(batch):
            parts = self._segments(t)
            if parts is None:
                odd[i] = self._chunks(t)
            else:
                rows += [i] * len(parts)
                firsts += [True, *[False] * (len(parts) - 1)]
                texts += parts
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        codes, keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        row = np.repeat(np.array(rows, np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        number = {}  # chunks that are not among the dictionary's: first ones, those of odd texts, the end
        if not self.words:
            at = lists.offsets.to_numpy()[:-1][np.array(firsts, bool)] - lists.offsets[0].as_py() if texts else []
            for p in at:
                codes[p] = number.setdefault(" " + keys[codes[p]], len(keys) + len(number))
        more = [np.array([number.setdefault(k, len(keys) + len(number)) for k in parts], np.int64) for parts in odd.values()]
        keys += number
        codes = np.concatenate([codes, *more])
        row = np.concatenate([row, *[np.full(len(m), i) for i, m in zip(odd, more)]])
        if end is not None:
            codes, row = np.append(codes, np.full(len(batch), len(keys))), np.append(row, np.arange(len(batch)))
        if odd or end is not None:
            order = np.argsort(row, kind="stable")
            codes, row = codes[order], row[order]
        used = np.flatnonzero(np.bincount(codes[codes < len(keys)], minlength=len(keys)))
        ids = [b""] * (len(keys) + 1)
        for k, found in zip(used.tolist(), self._ids_of([keys[k] for k in used.tolist()])):
            ids[k] = found
        if end is not None:
            ids[-1] = np.array([end], self.dtype).tobytes()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        n = sizes[codes]
        before = np.cumsum(n) - n
        place = np.repeat(begins[codes] - before, n)
        place += np.arange(len(place))
        lengths = np.bincount(row, n, minlength=len(batch)).astype(np.int64)
        return np.frombuffer(b"".join(ids), self.dtype)[place], lengths

    def encode(self, batch: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        flat, lengths = self.encode_flat(batch)
        data, ends = flat.tobytes(), (np.cumsum(lengths) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, limit: int = REMEMBERED) -> ChunkEncoder:
    """One per Python worker, file and number of remembered chunks, kept between tasks."""
    return ChunkEncoder(path, limit)


def forget() -> None:
    """Free what this worker remembers, in tasks that encode nothing."""
    encoder.cache_clear()


def encoded_flat(
    batches: Iterator[pa.RecordBatch], path: str, end: int, limit: int = REMEMBERED, at_once: int = BYTES_AT_ONCE
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of all texts in a row, each with the end id; how many each has), some rows at a
    time, from batches of (doc_id, text). More remembered chunks and larger batches take memory for time."""
    enc = encoder(path, limit)
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + at_once, "right")))
            rows = batch.slice(at, stop - at)
            yield rows.column("doc_id"), *enc.encode_flat(rows.column("text").to_pylist(), end)
            at = stop
