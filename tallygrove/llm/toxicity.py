"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each link is a logistic regression
over counts of words and word beginnings, a few shape features and the greatest and summed log-odds of the words
present; links after the first also take the log-odds of the earlier categories.
Word log-odds of a training row leave its own fold out. They are trained on out-of-fold predictions
of the earlier links (words are chosen without the held-out fold as well), so
what a link sees in training is as good as what it sees later.

Fitting takes at most ``max_rows`` labelled documents, the ones whose ids have the smallest
hashes; near copies of one text among them that share all of several min-hashes
count once, by the smallest id. All else covers every
document and every word of it.

Null texts count as empty; their probabilities come from the intercepts. Labels
that are null or of unknown documents are left out; of several labels for an id the greatest counts.
Repeated rows and null ids are scored like others. Without labelled rows every
probability is 0. An empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import SPACE, cut, let, texts

CATEGORIES = ("quality", "toxic")
MAX_ROWS = 10_000
FOLDS = 4
SKETCH = 8  # min-hashes that near copies in the training sample share
TOP_WORDS = 150  # per category and sign of association
MIN_DOCS = 4
RIDGE = 1.0
FEW_RIDGE = 0.01
THRESHOLD = 0.5
PREFIXES = (4, 5)  # beginnings of longer words are features too, written with a star

_WORD = re.compile(r"[^\W_]+")
_SYMBOLS = "#*$%&|<>"
N_SHAPE = 3


@dataclass
class Link:
    words: list[str]
    odds: np.ndarray  # log-odds of the category given each word
    weights: np.ndarray  # words, shape features, two of word odds, earlier log-odds, intercept


@dataclass
class Chain:
    categories: Sequence[str]
    links: list[Link] = field(default_factory=list)

    def vocabulary(self) -> list[str]:
        return sorted({w for link in self.links for w in link.words})


def _shape(text: str, counts: Counter) -> tuple[float, float, float]:
    n = sum(counts.values())
    return (
        np.log1p(n) / 5,
        sum(map(text.count, _SYMBOLS)) / (n + 1),
        len(counts) / (n + 1),
    )


def features(batch: Sequence[str], vocabulary: Sequence[str]) -> np.ndarray:
    """log(1 + count) of each word and word beginning of the vocabulary, then the shape features."""
    index = {w: k for k, w in enumerate(vocabulary)}
    out = np.zeros((len(batch), len(vocabulary) + N_SHAPE), np.float32)
    for i, text in enumerate(batch):
        counts = Counter(_WORD.findall(text.lower()))
        out[i, len(vocabulary) :] = _shape(text, counts)
        for w, n in counts.items():
            if w in index:
                out[i, index[w]] += n
            for k in PREFIXES:
                if len(w) > k and (stem := w[:k] + "*") in index:
                    out[i, index[stem]] += n
    out[:, : len(vocabulary)] = np.log1p(out[:, : len(vocabulary)])
    return out


def _fit(x: np.ndarray, y: np.ndarray, n_words: int) -> np.ndarray:
    """Logistic regression by Newton steps. The first ``n_words`` weights are shrunk; the
    few others and the intercept, which comes last, nearly free."""
    x = np.hstack([x, np.ones((len(x), 1))], dtype=np.float32, casting="same_kind")
    penalty = np.full(x.shape[1], FEW_RIDGE)
    penalty[:n_words] = RIDGE
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        slope, curve = -penalty * w, np.diag(penalty)
        for at in range(0, len(x), 2000):  # in parts, to keep the driver small
            part = x[at : at + 2000].astype(np.float64)
            p = _sigmoid(part @ w)
            slope += part.T @ (y[at : at + 2000] - p)
            curve += part.T @ (part * (p * (1 - p))[:, None])
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _top_words(words: np.ndarray, pos: np.ndarray, n: np.ndarray, all_pos: float, all_n: float) -> list[str]:
    """Words most associated with a category, by chi-square, either way."""
    rate = all_pos / max(all_n, 1)
    expected = n * rate
    score = np.where(n >= MIN_DOCS, (pos - expected) / np.sqrt(np.maximum(expected * (1 - rate), 1e-9)), 0.0)
    order = np.argsort(score, kind="stable")
    chosen = [*order[::-1][:TOP_WORDS], *order[:TOP_WORDS]]
    return sorted({str(words[k]) for k in chosen if score[k]})


def _word_odds(pos: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """How much each word shifts the log-odds, drawn towards 0 where it is rare."""
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    return np.log((pos + rate) / (n - pos + 1 - rate)) - np.log(rate / (1 - rate))


def _odds_features(counts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    present = np.where(counts > 0, odds, 0.0)
    most = present.max(axis=1, initial=0.0)
    return np.stack([most / 2, np.maximum(present, 0).sum(axis=1) / 10], axis=1)


def training_rows(documents: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int) -> DataFrame:
    """(doc_id, text, categories, fold) of a bounded sample, one of each set of near copies."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)])
    ys = [f"y{k}" for k in range(len(categories))]
    known = known.na.drop().groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts(documents).join(F.broadcast(known), "doc_id")  # at most max_rows small rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(y).alias(y) for y in ys])

    def sketch(w: Column) -> Column:
        shingles = F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(shingles, lambda s: F.array(*[F.array_min(F.transform(s, lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(SKETCH)]))

    rows = rows.withColumn("sketch", let(F.split(F.lower("text"), SPACE), sketch))
    rows = rows.groupBy("sketch").agg(F.min_by(F.struct("doc_id", "text", *ys), "doc_id").alias("first")).select("first.*")
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))


def _word_counts(rows: DataFrame, n: int):
    """Per word: documents that hold it, in all and positive per category, by fold."""

    def with_stems(w: Column) -> Column:
        stems = [F.transform(F.filter(w, lambda x, k=k: F.length(x) > k), lambda x, k=k: F.concat(F.substring(x, 1, k), F.lit("*"))) for k in PREFIXES]
        return F.array_distinct(F.concat(w, *stems))

    tokens = let(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), with_stems)
    exploded = rows.select("fold", *[f"y{k}" for k in range(n)], F.explode(tokens).alias("word"))
    sums = []
    for f in range(FOLDS):
        inside = F.col("fold") == f
        sums.append(F.sum(F.when(inside, 1.0).otherwise(0.0)).alias(f"n_{f}"))
        sums += [F.sum(F.when(inside, F.col(f"y{k}")).otherwise(0.0)).alias(f"p{k}_{f}") for k in range(n)]
    counts = exploded.groupBy("word").agg(F.count("*").alias("df"), *sums)
    return counts.filter(F.col("df") >= MIN_DOCS).filter("word <> ''").orderBy("word").toPandas()


def fit(
    documents: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, max_rows: int = MAX_ROWS
) -> Chain:
    """Fit the chain on at most ``max_rows`` labelled documents."""
    rows = cut(training_rows(documents, labels, categories, max_rows), "training")
    n_cat = len(categories)
    counts = _word_counts(rows, n_cat)
    words = counts["word"].to_numpy()
    n = np.stack([counts[f"n_{f}"].to_numpy(float) for f in range(FOLDS)])
    pos = np.stack([[counts[f"p{k}_{f}"].to_numpy(float) for f in range(FOLDS)] for k in range(n_cat)])
    meta = rows.select("doc_id", "fold", *[f"y{k}" for k in range(n_cat)]).orderBy("doc_id").toPandas()
    if not len(meta):
        return Chain(categories)
    y = meta[[f"y{k}" for k in range(n_cat)]].to_numpy(float).T
    fold = meta["fold"].to_numpy()

    def chosen(k: int, out: int | None) -> list[str]:
        use = [f for f in range(FOLDS) if f != out]
        inside = fold != out if out is not None else np.ones(len(fold), bool)
        return _top_words(words, pos[k][use].sum(0), n[use].sum(0), y[k][inside].sum(), inside.sum())

    picks = {(k, out): chosen(k, out) for k in range(n_cat) for out in [*range(FOLDS), None]}
    vocabulary = sorted({w for p in picks.values() for w in p})
    x = _sample_features(rows, vocabulary, meta["doc_id"].to_numpy())
    place = {w: j for j, w in enumerate(vocabulary)}
    shape = list(range(len(vocabulary), len(vocabulary) + N_SHAPE))

    row_of = {w: j for j, w in enumerate(words)}
    chain, earlier = Chain(categories), np.zeros((len(x), 0))
    for k in range(n_cat):
        own = picks[k, None]
        at, cols = [row_of[w] for w in own], [place[w] for w in own]
        total_pos, total_n, rate = pos[k][:, at].sum(0), n[:, at].sum(0), y[k].mean()
        hints = np.zeros((len(x), 2))
        for f in range(FOLDS):
            inside = fold == f
            odds = _word_odds(total_pos - pos[k][f, at], total_n - n[f, at], rate)
            hints[inside] = _odds_features(x[inside][:, cols], odds)
        held_out = np.zeros(len(x))
        for out in range(FOLDS):
            some = [place[w] for w in picks[k, out]] + shape
            inside = fold != out
            if not inside.any() or inside.all():
                continue
            data = np.hstack([x[:, some], hints, earlier], dtype=np.float32, casting="same_kind")
            w = _fit(data[inside], y[k][inside], len(picks[k, out]))
            held_out[~inside] = data[~inside] @ w[:-1] + w[-1]
        weights = _fit(np.hstack([x[:, cols + shape], hints, earlier]), y[k], len(own))
        chain.links.append(Link(own, _word_odds(total_pos, total_n, rate), weights))
        earlier = np.hstack([earlier, np.clip(held_out, -8, 8)[:, None] / 4])
    return chain


def _sample_features(rows: DataFrame, vocabulary: Sequence[str], ids: np.ndarray) -> np.ndarray:
    """The feature matrix of the bounded sample, in the order of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = features(part.column("text").to_pylist(), vocabulary)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = rows.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(ids), -1)
    return x[order]


def probabilities(batch: Sequence[str], chain: Chain) -> np.ndarray:
    """One column per category."""
    if not chain.links:
        return np.zeros((len(batch), len(chain.categories)))
    vocabulary = chain.vocabulary()
    place = {w: j for j, w in enumerate(vocabulary)}
    x = features(batch, vocabulary)
    shape = list(range(len(vocabulary), len(vocabulary) + N_SHAPE))
    earlier, out = np.zeros((len(batch), 0)), []
    for link in chain.links:
        cols = [place[w] for w in link.words]
        inputs = [x[:, cols + shape], _odds_features(x[:, cols], link.odds), earlier]
        odds = np.hstack(inputs) @ link.weights[:-1] + link.weights[-1]
        out.append(_sigmoid(odds))
        earlier = np.hstack([earlier, np.clip(odds, -8, 8)[:, None] / 4])
    return np.stack(out, axis=1)


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and ``p_<category>`` of every document."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                p = probabilities(part.column("text").to_pylist(), chain)
                yield pa.record_batch({"doc_id": part.column("doc_id")} | {c: pa.array(p[:, k]) for k, c in enumerate(names)})

    return texts(documents).mapInArrow(run, "doc_id bigint, " + ", ".join(f"`{c}` double" for c in names))


def reject(documents: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that stay below the threshold."""
    which = list(chain.categories).index(category)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                given = [t if t is not None else "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(probabilities(given, chain)[:, which] < threshold))

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, category: str = "toxic", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """Fit on the labels, then score every document; ``rejected`` where the category's probability reaches the threshold."""
    scored = score(documents, fit(documents, labels, **fitting))
    return scored.withColumn("rejected", F.col(f"p_{category}") >= threshold)
