"""Tables that are published in versions: replaced, extended and corrected without a
moment in which a reader or a crash could meet half of it.

Files are never changed. A write puts new files into a folder of its own (a run) and
then publishes the next version: a small log file that lists the folders which make up
the table. Until that file appears, in one rename, readers see the version before it;
a write that is broken off leaves files that no version lists.

    table/_log/000000000007.json            what version 7 consists of
    table/data/table_run=.../sale_chunk=.../sale_month=.../part-....parquet
    table/_days/table_run=.../part-....parquet   rows per day of the run

Two writers that start from the same version cannot both publish the next one. Adding
or replacing a chunk is then applied to the version the other has published; replacing
or correcting the table fails with :class:`VersionConflict`, to be run again.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.session import brief_shuffles, sized_tasks
from tallygrove.sources.storage import Folder

RUN = "table_run"
CHUNK = "sale_chunk"
BASE = "base"  # chunk of a table written whole
ADDED = "added"  # chunk of new keys of an upsert
LOG, DATA, DAYS = "_log", "data", "_days"
CHUNK_ID = r"[A-Za-z][A-Za-z0-9_.-]*"
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
RETRIES = 20


class VersionConflict(RuntimeError):
    """Another writer published a version in between."""


@dataclass
class Version:
    """One entry of the log. ``runs``: live folders below each run, "chunk/partition" or "chunk".
    ``whole``: runs of which no folder is dead. ``ledger``: what is known of each chunk.
    ``streams``: the last batch that each stream has published."""

    number: int
    action: str
    schema: dict | None = None
    by: str | None = None
    runs: dict[str, list[str]] = field(default_factory=dict)
    whole: list[str] = field(default_factory=list)
    ledger: dict[str, dict] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    at: float = 0.0

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema) if self.schema else T.StructType([])

    def without(self, dead: Callable[[str, str], bool]) -> Version:
        """Without the folders for which ``dead(run, folder)`` holds."""
        runs, whole = {}, []
        for run, folders in self.runs.items():
            live = [f for f in folders if not dead(run, f)]
            if live:
                runs[run] = live
                if run in self.whole and len(live) == len(folders):
                    whole.append(run)
        return Version(self.number, self.action, self.schema, self.by, runs, whole, dict(self.ledger), dict(self.streams))

    def with_run(self, run: str, folders: list[str]) -> Version:
        if not folders:
            return self
        return Version(
            self.number, self.action, self.schema, self.by, {**self.runs, run: folders}, [*self.whole, run], self.ledger, self.streams
        )


def is_versioned(spark: SparkSession, path: str) -> bool:
    return Folder(spark, path).exists(LOG)


class VersionedTable:
    """A table at a path. ``by`` names the partition column, derived by ``layout(rows, by, laid_out)``, of rows
    written from now on; ``days`` the column whose days are counted for paging."""

    def __init__(
        self, spark: SparkSession, path: str, by: str | None = None,
        layout: Callable[[DataFrame, str, bool], DataFrame] | None = None, days: str | None = None, bloom: Sequence[str] = (),
    ):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.by, self.layout, self.day, self.bloom = by, layout, days, bloom

    # --- versions ---

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names(LOG) if re.fullmatch(r"\d+\.json", n)]

    def head(self) -> Version:
        """The latest version; number 0, without rows, before the first."""
        numbers = self.versions()
        return self.version(max(numbers)) if numbers else Version(0, "none")

    def version(self, number: int) -> Version:
        return Version(**json.loads(self.folder.read(f"{LOG}/{number:012d}.json")))

    def history(self) -> DataFrame:
        """(version, action, at, runs, folders), newest first."""
        rows = [
            (v.number, v.action, v.at, len(v.runs), sum(map(len, v.runs.values()))) for v in map(self.version, sorted(self.versions(), reverse=True))
        ]
        return self.spark.createDataFrame(rows, "version bigint, action string, at double, runs int, folders int")

    def _publish(self, old: Version, new: Version, action: str) -> int:
        number = old.number + 1
        entry = {**new.__dict__, "number": number, "action": action, "at": time.time()}
        if not self.folder.create(f"{LOG}/{number:012d}.json", json.dumps(entry)):
            raise VersionConflict(f"version {number} of {self.path} was published by another writer")
        return number

    def _publish_edit(self, edit: Callable[[Version], Version], action: str) -> int:
        """Publish an edit that can be applied to whatever version is the latest."""
        for k in range(RETRIES):
            old = self.head()
            try:
                return self._publish(old, edit(old), action)
            except VersionConflict:
                time.sleep(0.05 * k)
        raise VersionConflict(f"{self.path} is published to all the time")

    # --- reading ---

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default, with its partition column behind its own.
        Later versions do not change what was read."""
        v = self.head() if version is None else self.version(version)
        return self._rows(v).drop(RUN, CHUNK)

    def _rows(self, v: Version, only: Iterable[tuple[str, str]] | None = None) -> DataFrame:
        fields = [*v.struct.fields, T.StructField(RUN, T.StringType()), T.StructField(CHUNK, T.StringType())]
        if v.by:
            fields.append(T.StructField(v.by, T.DateType()))
        schema, data = T.StructType(fields), f"{self.path}/{DATA}"
        if only is not None:
            paths = [f"{data}/{RUN}={run}/{f}" for run, f in only]
        else:
            paths = [
                p for run, folders in v.runs.items()
                for p in ([f"{data}/{RUN}={run}"] if run in v.whole else [f"{data}/{RUN}={run}/{f}" for f in folders])
            ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", data).parquet(*paths)

    def rows_per_day(self) -> DataFrame:
        """(day, n) of the latest version, from counts stored with each run."""
        v = self.head()
        schema = f"{CHUNK} string, part date, day date, n bigint, {RUN} string"
        runs = [r for r in v.runs if self.folder.exists(f"{DAYS}/{RUN}={r}")]
        if len(runs) < len(v.runs):
            raise ValueError("some runs were written without day counts")
        if not runs:
            return self.spark.createDataFrame([], "day date, n bigint")
        counts = self.spark.read.schema(schema).option("basePath", f"{self.path}/{DAYS}").parquet(*[f"{self.path}/{DAYS}/{RUN}={r}" for r in runs])
        partial = [r for r in runs if r not in v.whole]
        if partial:
            live = [(r, *self._parsed(f)) for r in partial for f in v.runs[r]]
            listed = F.broadcast(self.spark.createDataFrame(live, f"{RUN} string, {CHUNK} string, part date"))
            same = (counts[RUN] == listed[RUN]) & (counts[CHUNK] == listed[CHUNK]) & counts["part"].eqNullSafe(listed["part"])
            counts = counts.filter(~F.col(RUN).isin(partial)).unionByName(counts.join(listed, same, "left_semi"))
        return counts.groupBy("day").agg(F.sum("n").alias("n"))

    @staticmethod
    def _parsed(folder: str):
        import datetime as dt

        chunk, _, part = folder.partition("/")
        value = part.partition("=")[2]
        return chunk.partition("=")[2], dt.date.fromisoformat(value) if value and value != _NO_VALUE else None

    # --- writing ---

    def write_run(self, rows: DataFrame, laid_out: bool = False) -> tuple[str, list[str]]:
        """Write rows with a chunk column into a new run, not yet part of any version: (run, folders).
        Rows read from files that are ``laid_out`` by the partition column already are not shuffled for it."""
        run = uuid.uuid4().hex
        path = f"{self.path}/{DATA}/{RUN}={run}"
        writer = (self.layout(rows, self.by, laid_out) if self.by else rows).write.partitionBy(CHUNK, *([self.by] if self.by else []))
        for name in self.bloom:
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        with sized_tasks(rows.sparkSession):
            writer.parquet(path)
        base = f"{DATA}/{RUN}={run}"
        chunks = self.folder.folders(base)
        folders = [f"{c}/{p}" for c in chunks for p in self.folder.folders(f"{base}/{c}")] if self.by else chunks
        if folders and self.day:
            written = self._rows(Version(0, "", self._schema(rows), self.by, {run: folders}, [run]))
            part = F.col(self.by) if self.by else F.lit(None).cast("date")
            counts = written.groupBy(CHUNK, part.alias("part"), F.to_date(self.day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
            with brief_shuffles(rows.sparkSession):
                counts.coalesce(1).write.parquet(f"{self.path}/{DAYS}/{RUN}={run}")
        return run, folders

    def _schema(self, rows: DataFrame) -> dict:
        own = [f for f in rows.schema.fields if f.name not in (CHUNK, self.by)]
        return json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in own]).json())

    def replace(self, rows: DataFrame, laid_out: bool = False) -> int:
        """All rows anew, as the next version: its number. ``laid_out`` as for :meth:`write_run`."""
        old = self.head()
        tagged = rows.withColumn(CHUNK, F.lit(BASE))
        run, folders = self.write_run(tagged, laid_out)
        new = Version(0, "", self._schema(tagged), self.by).with_run(run, folders)
        new.streams = dict(old.streams)
        return self._publish(old, new, "replace")

    def append(self, rows: DataFrame, chunk: str, laid_out: bool = False) -> int:
        """Add a chunk. Rows of an earlier chunk of that id, whatever partitions they lie in, are replaced."""
        if not re.fullmatch(CHUNK_ID, chunk):
            raise ValueError("a chunk id starts with a letter and holds letters, digits, _ . and -")
        return self.put_chunks(rows.withColumn(CHUNK, F.lit(chunk)), {chunk: {}}, f"append {chunk}", laid_out=laid_out)

    def put_chunks(
        self, rows: DataFrame, ledger: dict[str, dict], action: str, stream: tuple[str, int] | None = None, laid_out: bool = False
    ) -> int:
        """Add or replace the chunks named in ``ledger``; rows tell theirs in the chunk column. With
        ``stream`` (id, batch), a batch that was published before is not published again."""
        run, folders = self.write_run(rows, laid_out)
        schema, by = self._schema(rows), self.by

        def edit(old: Version) -> Version:
            if old.by not in (None, by) and old.runs:
                raise ValueError(f"the table is laid out by {old.by}")
            new = old.without(lambda _, f: f.split("/")[0].partition("=")[2] in ledger).with_run(run, folders)
            new.schema, new.by = new.schema or schema, by
            new.ledger = {**old.ledger, **ledger}
            new.streams = {**old.streams, **({stream[0]: stream[1]} if stream else {})}
            return new

        return self._publish_edit(edit, action)

    def upsert(self, new: DataFrame, keys: Sequence[str]) -> int:
        """Replace the rows that have a key of ``new`` and add the keys that are new. A null key is a key
        like others. Of several new rows with a key the last one by all columns counts.

        Copy on write: the folders that hold a key are found by the key columns alone; only those
        are written anew, the others stay as they are, file by file. A row keeps its chunk; one whose
        date changed moves to the folder of its new date, beside that folder's files.
        """
        old = self.head()
        if not old.runs:
            return self._publish(old, self._first(new), "upsert")
        columns = old.struct.fieldNames()
        place = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        latest = new.groupBy(*place).agg(F.max(F.struct(*columns)).alias("_row"))
        present = self._rows(old)
        by = [old.by] if old.by else []
        with brief_shuffles(self.spark):
            touched = present.join(latest, self._same(present, latest, keys), "left_semi").select(RUN, CHUNK, *by).distinct().collect()
        dead = {(r[RUN], self._folder(r[CHUNK], r[by[0]] if by else None, old.by)) for r in touched}
        table = self._at(old.by)
        before = self._rows(old, sorted(dead)) if dead else present.limit(0)
        kept = before.join(latest, self._same(before, latest, keys), "left_anti").select(*columns, CHUNK)
        homes = before.groupBy(*place).agg(F.min(CHUNK).alias("_home"))
        homes = homes.select(*[F.col(f"_k{i}").alias(f"_h{i}") for i in range(len(keys))], "_home")
        match = [F.col(f"_k{i}").eqNullSafe(F.col(f"_h{i}")) for i in range(len(keys))]
        fresh = latest.join(homes, match, "left").select("_row.*", F.coalesce("_home", F.lit(ADDED)).alias(CHUNK))
        run, folders = table.write_run(kept.unionByName(fresh))
        return self._publish(old, old.without(lambda r, f: (r, f) in dead).with_run(run, folders), "upsert")

    def _first(self, new: DataFrame) -> Version:
        tagged = new.withColumn(CHUNK, F.lit(ADDED))
        run, folders = self.write_run(tagged)
        return Version(0, "", self._schema(tagged), self.by).with_run(run, folders)

    def _at(self, by: str | None) -> VersionedTable:
        return VersionedTable(self.spark, self.path, by, self.layout, self.day, self.bloom)

    @staticmethod
    def _same(rows: DataFrame, latest: DataFrame, keys: Sequence[str]) -> list[Column]:
        return [rows[k].eqNullSafe(latest[f"_k{i}"]) for i, k in enumerate(keys)]

    @staticmethod
    def _folder(chunk: str, part, by: str | None) -> str:
        return f"{CHUNK}={chunk}" + (f"/{by}={_NO_VALUE if part is None else part.isoformat()}" if by else "")

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> list[str]:
        """Delete all versions but the latest ``keep``, and the folders that only they, or no version,
        list. Folders written within the last ``hours`` stay: a writer may be about to publish them."""
        numbers = sorted(self.versions())
        kept = numbers[-max(keep, 1) :]
        live = {(r, f) for n in kept for r, folders in self.version(n).runs.items() for f in folders}
        runs, limit, gone = {r for r, _ in live}, time.time() - hours * 3600, []
        for n in numbers:
            if n not in kept:
                self.folder.delete(f"{LOG}/{n:012d}.json")
        for name in self.folder.folders(DATA):
            run, here = name.partition("=")[2], f"{DATA}/{name}"
            if self.folder.modified(here) > limit:
                continue
            if run not in runs:
                gone.append(here)
                self.folder.delete(f"{DAYS}/{name}")
            else:
                nested = [f"{c}/{p}" for c in self.folder.folders(here) for p in self.folder.folders(f"{here}/{c}")]
                gone += [f"{here}/{f}" for f in nested or self.folder.folders(here) if (run, f) not in live]
        for g in gone:
            self.folder.delete(g)
        return gone
