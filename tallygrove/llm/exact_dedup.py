"""Exact duplicates of a new batch against an immutable snapshot.

Texts are equal when they are identical without white space. The snapshot keeps
one row per distinct digest and, per bucket of digests, a static binary-fuse filter
(about nine bits a digest, no false negatives, 0.4 % false positives). A new
batch is first grouped by itself; its distinct digests are screened by the
filters, and only positives join the snapshot's exact buckets. Every group of two
or more rows is then checked byte by byte: its least and its greatest text must be
the same. Rows whose digests collide are grouped by their texts instead.

Null texts count as empty and equal each other. Repeated rows and repeated or null
ids are rows of their own; of ties the smallest id stays (null first), of rows
that also tie there each one is reported with the same ``keep_id``, and ``kept`` is true for
all of them (they cannot be told apart). An empty table gives no rows. Columns
other than id and text are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.common import SPACE, cut, scratch, texts

FILTER_KEYS = 200_000  # digests per filter
SALTS = 32
FILTER_SCHEMA = "bucket int, seed bigint, segment int, segments int, cells binary"
CLASSES_SCHEMA = "digest string, best struct<n_chars:bigint,no_id:boolean,minus_id:bigint>, group_size bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


class FuseFilter:
    """Binary-fuse filter with three cells and eight bits a key."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys.astype(np.uint64) + np.uint64(seed)
        for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(k)
        return h ^ (h >> np.uint64(33))

    def _cells_of(self, h: np.ndarray) -> np.ndarray:
        """Three cells per key, in neighbouring segments."""
        span = np.uint64(self.segments * self.segment)
        first = (((h >> np.uint64(32)) * span) >> np.uint64(32)).astype(np.int64)
        mask = self.segment - 1
        low = h.astype(np.int64)
        second = (first + self.segment) ^ ((low >> 18) & mask)
        third = (first + 2 * self.segment) ^ (low & mask)
        return np.stack([first, second, third])

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys)
        n = max(len(keys), 2)
        segment = min(1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)), 1 << 18)
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        for seed in range(1, 200):
            cells = int(n * factor * (1 + 0.01 * (seed // 10)))
            out = cls(seed, segment, max(1, -(-cells // segment) - 2), np.zeros(0, np.uint8))
            if out._fill(cls._mix(keys, seed)):
                return out
        raise RuntimeError("no seed gives a filter")

    def _fill(self, h: np.ndarray) -> bool:
        """Peel keys that are alone in a cell, round by round, then set the cells
        in the opposite order. Keys of one round share no cell that either sets."""
        size = (self.segments + 2) * self.segment
        places, index = self._cells_of(h), np.arange(len(h))
        count = np.bincount(places.reshape(-1), minlength=size)
        holder = np.zeros(size, np.int64)
        for p in places:
            np.bitwise_xor.at(holder, p, index)
        rounds, look = [], np.flatnonzero(count == 1)
        left = len(h)
        while len(look):
            key, at = np.unique(holder[look], return_index=True)
            rounds.append((key, look[at]))
            touched = places[:, key]
            for p in touched:
                np.subtract.at(count, p, 1)
                np.bitwise_xor.at(holder, p, key)
            left -= len(key)
            near = np.unique(touched)
            look = near[count[near] == 1]
        if left:
            return False
        self.cells, prints = np.zeros(size, np.uint8), self._print(h)
        for key, cell in reversed(rounds):
            p = places[:, key]
            self.cells[cell] = 0
            self.cells[cell] = prints[key] ^ self.cells[p[0]] ^ self.cells[p[1]] ^ self.cells[p[2]]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = self._mix(keys, self.seed)
        p = self._cells_of(h)
        return self.cells[p[0]] ^ self.cells[p[1]] ^ self.cells[p[2]] == self._print(h)


def digests(df: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, n_chars (code points as they are) and digest of each row."""
    return texts(df).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), digest(normalised(F.col("text"))).alias("digest")
    )


def _best() -> list[Column]:
    """Of a group: the row that stays (most code points, then smallest id, null before all) and the number of rows."""
    rank = F.struct(F.col("n_chars"), F.col("doc_id").isNull().alias("no_id"), (-F.col("doc_id")).alias("minus_id"))
    return [F.max(rank).alias("best"), F.count("*").alias("group_size")]


def _merge() -> list[Column]:
    return [F.max("best").alias("best"), F.sum("group_size").alias("group_size")]


def _key() -> Column:
    """60 bits of the digest's own hash, even where a digest is short."""
    return F.conv(F.substring(F.md5("digest"), 1, 15), 16, 10).cast("bigint")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def build_filters(groups: DataFrame, n_buckets: int) -> DataFrame:
    """One filter per bucket of distinct digests."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(rows["key"].to_numpy(np.uint64))
        return pd.DataFrame([(key[0], f.seed, f.segment, f.segments, f.cells.tobytes())], columns=["bucket", "seed", "segment", "segments", "cells"])

    rows = groups.select(_bucket(n_buckets).alias("bucket"), _key().alias("key"))
    return rows.groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(groups: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """Distinct digests of a batch with ``maybe``: false means surely not in the snapshot."""

    def test(rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = rows[["digest"]].copy()
        if len(stored) and len(rows):
            s = stored.iloc[0]
            f = FuseFilter(int(s["seed"]), int(s["segment"]), int(s["segments"]), np.frombuffer(s["cells"], np.uint8))
            out["maybe"] = f.contains(rows["key"].to_numpy(np.uint64))
        else:
            out["maybe"] = False
        return out

    rows = groups.select("digest", _bucket(n_buckets).alias("bucket"), _key().alias("key"))
    return rows.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "digest string, maybe boolean")


def collided(df: DataFrame, suspects: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests among ``suspects`` whose texts are not all the same bytes. Rows of one
    digest are dealt over SALTS tasks, each leaves its least and greatest text."""
    text = texts(df).select(normalised(F.col("text")).alias("norm"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("salt"))
    text = text.withColumn("digest", digest(F.col("norm")))
    salted = suspects.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ends = (
        text.join(salted, ["digest", "salt"], "left_semi")
        .groupBy("digest", "salt")
        .agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    )
    ends = ends.groupBy("digest").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return ends.filter("least <> greatest").select("digest")


class Snapshots:
    """Immutable snapshots below a folder, numbered from 1: the ``classes`` of all rows so far (digest,
    the row that stays, how many there are) and, per bucket of digests, a ``filters`` row. A snapshot is
    complete once its ``done`` note is there; a number without it is left over from a crash, and not used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def latest(self) -> int:
        """The number of the last complete snapshot, 0 before the first."""
        try:
            return self._read("done", "number int").agg(F.max("number")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def classes(self, number: int) -> DataFrame:
        if not number:
            return self.spark.createDataFrame([], CLASSES_SCHEMA)
        return self._read(f"classes-{number}", CLASSES_SCHEMA)

    def write(self, classes: DataFrame) -> int:
        """The next snapshot, with filters over its digests."""
        number = self.latest() + 1
        classes.write.mode("overwrite").parquet(f"{self.folder}/classes-{number}")
        stored = self.classes(number)
        n_buckets = max(1, -(-stored.count() // FILTER_KEYS))
        built = build_filters(stored, n_buckets).withColumn("n_buckets", F.lit(n_buckets))
        built.write.mode("overwrite").parquet(f"{self.folder}/filters-{number}")
        self.spark.createDataFrame([(number,)], "number int").coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
        return number

    def known(self, batch: DataFrame) -> DataFrame:
        """(digest) of those classes of a batch that the latest snapshot has: screened by its filters, then
        looked up in its exact buckets."""
        number = self.latest()
        if not number:
            return batch.select("digest").limit(0)
        filters = self._read(f"filters-{number}", FILTER_SCHEMA + ", n_buckets int")
        first = filters.first()
        n_buckets = first["n_buckets"] if first else 1
        screened = cut(screen(batch, filters.drop("n_buckets"), n_buckets), "screened")
        positive = batch.select("digest").join(screened.filter("maybe").select("digest"), "digest", "left_semi")
        return positive.join(self.classes(number).select("digest"), "digest", "left_semi")

    def add(self, batch: DataFrame) -> int:
        """The next snapshot: the classes of a batch joined to those of the latest one."""
        again = cut(self.known(batch), "known")
        old = self.classes(self.latest())
        merged = old.unionByName(batch.join(again, "digest", "left_semi")).groupBy("digest").agg(*_merge())
        return self.write(merged.unionByName(batch.join(again, "digest", "left_anti")))


def classes_of(keys: DataFrame) -> DataFrame:
    """(digest, best, group_size) of what :func:`digests` gives."""
    return keys.groupBy("digest").agg(*_best())


def deduplicate(
    df: DataFrame, is_new: Column, digest: Callable[[Column], Column] = sha256, folder: str | None = None
) -> DataFrame:
    """Every row with keep_id, group_size, kept and digest. ``is_new`` (over
    doc_id) tells the rows of the batch from those of the snapshot. Both snapshots, the one before and
    the one with the batch, stay below ``folder`` for batches to come (:class:`Snapshots`)."""
    spark = df.sparkSession
    keys = cut(digests(df, digest).withColumn("is_new", F.coalesce(is_new, F.lit(True))), "digests")
    snapshots = Snapshots(spark, folder or scratch(spark, "snapshots"))
    snapshots.write(classes_of(keys.filter("NOT is_new")))
    classes = snapshots.classes(snapshots.add(cut(classes_of(keys.filter("is_new")), "batch")))

    wrong = cut(collided(df, classes.filter("group_size > 1"), digest), "collided")
    if wrong.isEmpty():
        return _rows(keys, classes)
    # Digests that stand for several texts: their rows are grouped by the text.
    own = texts(df).withColumn("norm", normalised(F.col("text")))
    own = own.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), digest(F.col("norm")).alias("first"), "norm"
    ).join(wrong.select(F.col("digest").alias("first")), "first", "left_semi")
    own = cut(own.select("doc_id", "n_chars", F.concat_ws(":", "first", "norm").alias("digest")), "by_text")
    clean_keys = keys.join(wrong, "digest", "left_anti").drop("is_new")
    clean = classes.join(wrong, "digest", "left_anti")
    split = _rows(own, own.groupBy("digest").agg(*_best()))
    return _rows(clean_keys, clean).unionByName(split)


def _rows(keys: DataFrame, classes: DataFrame) -> DataFrame:
    joined = keys.join(classes, "digest")
    keep_id = -F.col("best.minus_id")
    same = F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_chars") == F.col("best.n_chars"))
    return joined.select("doc_id", keep_id.alias("keep_id"), "group_size", same.alias("kept"), "digest")
