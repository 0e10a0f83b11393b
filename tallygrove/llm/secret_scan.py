"""Secret scans with an incremental ledger of blobs.

A blob is a text named by its SHA-256; paths (documents, or any historical
version of them) point to blobs. The ledger holds which (blob, rule version)
pairs were scanned and what was found, so a rerun, a copy or an old version costs
no scan, and a new rule version scans each blob once more. Findings belong to
blobs and are joined back to every path.

Texts that hold none of the rules' fixed parts cannot have a finding; they are
noted as scanned from a cheap test in the pass that hashes them, and only the few
others are moved, one copy per blob.

Null texts count as empty. Repeated rows, ids and null ids are paths of their own. An
empty table gives empty results. Other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, scratch, texts


@dataclass(frozen=True)
class Rule:
    """``least`` is the size the group needs; ``hint`` is a pattern that every text with a finding holds."""

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


# A key with its body: up to the END line where no other line of five dashes comes first, else over
# the base64 lines that follow, the last of which may be short. Line ends may be written as escapes.
_GAP = r"(?:[\x09-\x0D\x20]|\\[rnt])+"
_KEY = (
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    r"(?:[^-]*(?:-{1,4}[^-]+)*-{5,}END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:Proc-Type: ?4,ENCRYPTED|DEK-Info: ?[A-Z0-9-]+,[0-9A-Fa-f]+))*"
    rf"(?:{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:{_GAP}[A-Za-z0-9+/]+={{0,2}})?)?"
)

# In this order kinds are listed where spans start together. The first three are the base.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24),
    Rule("private_key", _KEY, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("bearer", r"\bBearer ([A-Za-z0-9._~+/-]{20,}=*)", r"Bearer [A-Za-z0-9._~+/-]{20}"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,20}://[^\x09-\x0D\x20/:@]*:[^\x09-\x0D\x20/:@]{3,}@", r"://[^\x09-\x0D\x20/:@]*:[^\x09-\x0D\x20/:@]{3,}@"),
)
VERSION = "1.2"

SPANS = "array<struct<kind:string,start:int,stop:int>>"


def scan(text: str, rules: Sequence[Rule] = RULES) -> list[tuple[str, int, int]]:
    """Findings of one text, by start and then kind. Matches are leftmost and do not overlap within a kind."""
    found = [
        (m.start(), k, r.kind, m.end())
        for k, r in enumerate(rules)
        for m in re.finditer(r.pattern, text, re.ASCII)
        if len(m[r.group]) >= r.least
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def may_hold(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    return text.rlike("|".join(f"(?:{r.hint})" for r in rules))


def _scan_rows(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            found = [[dict(zip(("kind", "start", "stop"), s)) for s in scan(t.as_py(), rules)] for t in b.column("text")]
            yield pa.record_batch({"blob": b.column("blob"), "spans": pa.array(found, spans)})

    return rows.select("blob", "text").mapInArrow(run, f"blob string, spans {SPANS}")


class Ledger:
    """Stored below ``folder``: ``scanned`` (blob, version), ``findings`` (blob, version, spans)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self, version: str) -> DataFrame:
        return self._read("scanned", "blob string, version string").filter(F.col("version") == version).select("blob")

    def findings(self, version: str) -> DataFrame:
        """A blob that a crashed run wrote twice counts once."""
        rows = self._read("findings", f"blob string, version string, spans {SPANS}")
        return rows.filter(F.col("version") == version).select("blob", "spans").dropDuplicates(["blob"])

    def update(self, df: DataFrame, rules: Sequence[Rule] = RULES, version: str = VERSION) -> DataFrame:
        """Scan what is new and return the paths (doc_id, blob) of ``df``.
        Findings are written before the note that their blobs are scanned, so a run
        that breaks off scans them again and loses none."""
        maybe = may_hold(F.col("text"), rules)
        blob = F.sha2(F.encode("text", "UTF-8"), 256).alias("blob")
        # One pass over the texts: those that may hold something, which are few, are kept beside their hash.
        paths = cut(texts(df).select("doc_id", blob, F.when(maybe, F.col("text")).alias("text")), "paths")
        blobs = paths.groupBy("blob").agg(F.max(F.col("text").isNotNull()).alias("maybe"))
        new = cut(blobs.join(self.scanned(version), "blob", "left_anti"), "new-blobs")
        held = paths.filter("text IS NOT NULL").groupBy("blob").agg(F.first("text").alias("text"))  # copies meet in each task first
        todo = held.join(new.filter("maybe"), "blob", "left_semi")
        found = _scan_rows(todo, rules).filter(F.size("spans") > 0).withColumn("version", F.lit(version))
        found.select("blob", "version", "spans").write.mode("append").parquet(f"{self.folder}/findings")
        new.select("blob", F.lit(version).alias("version")).write.mode("append").parquet(f"{self.folder}/scanned")
        return paths.select("doc_id", "blob")


def find_secrets(df: DataFrame, ledger: Ledger | None = None, rules: Sequence[Rule] = RULES, version: str = VERSION) -> DataFrame:
    """doc_id, blob and ``spans`` of every path, empty where nothing was found."""
    spark = df.sparkSession
    ledger = ledger or Ledger(spark, scratch(spark, "blob-ledger"))
    paths = ledger.update(df, rules, version)
    joined = paths.join(ledger.findings(version), "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end``, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """The text with every span (kind, start, stop) replaced by ``[kind]``, in one pass; overlapping
    spans become one, named by the first."""
    out, at = [], 0
    for kind, start, stop in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact(text: Column, spans: Column) -> Column:
    """:func:`redacted` for a column, spans in order. Texts without spans do not pass through Python if
    the caller asks for this only where there are some."""

    @F.pandas_udf("string")
    def run(texts_: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else redacted(t, [(s["kind"], s["start"], s["stop"]) for s in (() if f is None else f)]) for t, f in zip(texts_, found)
        ], dtype=object)

    return run(text, spans)
