"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_local_scratch: str | None = None


def get_spark(master: str | None = None, app: str = "tallygrove", **conf: str) -> SparkSession:
    """A session with the settings the reports expect: UTC, AQE on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SORTED_BYTES = 32 * 2**20  # of a shuffle, compressed: what a task that sorts for a writer should read
SCANNED_BYTES = 16 * 2**20  # of Parquet files, which hold about twice as many rows in a byte


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written, or made and collected, here removes its shuffle files when it ends. Else they stay until the driver's
    garbage collection finds them unused, and those of one write lie beside the next. For DataFrames that are run once: one
    that is collected again shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def sized_tasks(spark: SparkSession) -> Iterator[None]:
    """Tasks of a write that sorts its rows read ``SORTED_BYTES`` of a shuffle at most, about an eighth of a GB in
    memory, or ``SCANNED_BYTES`` of files, so that no task has to spill its sort. A smaller target of the session
    stays as it is. The write's shuffles are brief."""
    limits = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": SORTED_BYTES, "spark.sql.files.maxPartitionBytes": SCANNED_BYTES}
    before = {key: spark.conf.get(key) for key in limits}
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, limit in limits.items():
        spark.conf.set(key, f"{min(limit, size(before[key]))}b")
    try:
        with brief_shuffles(spark):
            yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


HASHED_GROUPS = 20_000


@contextmanager
def hashed_groups(spark: SparkSession) -> Iterator[None]:
    """Aggregates of sketches keep ``HASHED_GROUPS`` groups a task before they sort their input, instead of 128. For
    the small tasks of :func:`sized_tasks`: a sketch holds a few bytes per row, so its task's rows bound their memory."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, HASHED_GROUPS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut a lineage: the one the cluster names in
    ``spark.checkpoint.dir``, under the application's id.

    Only a local session may do without the setting; executors of a cluster
    would not see a driver's temporary folder.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="tallygrove-")
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        base = _local_scratch
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def drop_shared(spark: SparkSession) -> None:
    """Remove the application's tables from the shared folder, at its end. Tables
    read from there are gone afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
