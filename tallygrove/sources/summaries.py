"""Aggregates kept beside a table of versions, a part for each run of files.

A run is summarised once, when the summary is first asked for after the run was published;
what a chunk adds is summed up with what is there, and nothing is counted again.
Rows of a summary are kept per folder of the run (chunk and partition), so folders that a
correction or a new delivery of a chunk has replaced drop out with their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.session import hashed_groups, sized_tasks
from tallygrove.sources.versions import CHUNK, RUN, Version, VersionedTable

_PART = "part"


class Summary:
    """``build(rows, keys)`` groups the rows by ``keys``, and more, and aggregates; ``schema`` is that of
    its result without the keys. Kept below ``_<name>`` of the table."""

    def __init__(self, table: VersionedTable, name: str, build: Callable[[DataFrame, Sequence[str]], DataFrame], schema: str):
        self.table, self.place, self.build, self.schema = table, f"_{name}", build, schema

    def _path(self, run: str) -> str:
        return f"{self.table.path}/{self.place}/{RUN}={run}"

    def refresh(self) -> list[str]:
        """Summarise the runs of the latest version that are not yet: their names. A run's summary counts
        once it has been written as a whole."""
        v, made = self.table.head(), []
        for run, folders in v.runs.items():
            if self.table.folder.exists(f"{self.place}/{RUN}={run}/_SUCCESS"):
                continue
            rows = self.table._rows(Version(0, "", v.schema, v.by, {run: folders}, [run] if run in v.whole else []))
            part = F.col(v.by) if v.by else F.lit(None).cast("date")
            out = self.build(rows.withColumn(_PART, part), [CHUNK, _PART])
            with sized_tasks(self.table.spark), hashed_groups(self.table.spark):
                out.write.mode("overwrite").parquet(self._path(run))
            made.append(run)
        return made

    def read(self) -> DataFrame:
        """The summary's rows of the latest version, several per group: one for each folder."""
        self.refresh()
        v, spark = self.table.head(), self.table.spark
        if not v.runs:
            return spark.createDataFrame([], self.schema)
        base = f"{self.table.path}/{self.place}"
        schema = f"{CHUNK} string, {_PART} date, {self.schema}, {RUN} string"
        rows = spark.read.schema(schema).option("basePath", base).parquet(*[self._path(r) for r in v.runs])
        partial = [r for r in v.runs if r not in v.whole]
        if partial:
            live = [(r, *VersionedTable._parsed(f)) for r in partial for f in v.runs[r]]
            listed = F.broadcast(spark.createDataFrame(live, f"{RUN} string, {CHUNK} string, {_PART} date"))
            same = (rows[RUN] == listed[RUN]) & (rows[CHUNK] == listed[CHUNK]) & rows[_PART].eqNullSafe(listed[_PART])
            rows = rows.filter(~F.col(RUN).isin(partial)).unionByName(rows.join(listed, same, "left_semi"))
        return rows.drop(CHUNK, _PART, RUN)
