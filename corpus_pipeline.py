"""From raw documents to packed training sequences, in stages.

Each stage takes what the one before kept, written as Parquet, and works on all of
it.

* Ids may repeat or be missing: rows are told apart by a key of their own, in a column whose
  name the documents do not use. All columns come out as they went in, whatever their names.
* A null text is read as an empty one and stays null: it is not toxic, it is a copy of other texts
  without visible characters, holds no secret, and is packed as its end id.
* Texts of any length are worked on whole. Repeated rows are exact copies, one of which stays. An
  empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import exact_dedup, packing, secret_scan, simhash, toxicity
from tallygrove.llm.common import free_name, load, scratch, tokenizer_file, unique_ids

# Near copies: sets of shingles of five words, Jaccard similarity of 80 % or more, checked on the
# sets. There the cosine is 8/9, and 15.1 % of the bits differ on average: 39 of 256, with a
# deviation of 6. Candidates share one of 40 bands of 7 min-hashes (at 80 %: all but 1 in
# 10,000 pairs) and differ in at most three deviations more.
SHINGLE = 5
SIMILAR = 80
NEAR = {"bits": 256, "radius": 57, "bands": 40, "band_rows": 7}


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key per row, and the name of its column."""
    key = free_name(docs, "row_key")
    return unique_ids(docs, key), key


def _texts(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text) with the row's key as the id."""
    return docs.select(F.col(key).alias("doc_id"), "text")


def _keep(docs: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The documents whose keys are listed (as ``doc_id``), all columns as they are."""
    columns = [c for c in docs.columns if c != key]
    return docs.join(rows.select(F.col("doc_id").alias(key)), key, "left_semi").select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the chain, fitted on the labels, takes for toxic."""
    return toxicity.reject(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts. Half is taken as the snapshot, half as the batch."""
    docs, key = _keyed(docs)
    rows = exact_dedup.deduplicate(_texts(docs, key), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    return _keep(docs, key, rows.filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    docs, key = _keyed(docs)
    rows = simhash.near_copies(_texts(docs, key), SHINGLE, SIMILAR, **NEAR)
    return _keep(docs, key, rows.filter("doc_id = component_id"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret replaced by its kind; other documents unchanged."""
    columns = docs.columns
    docs, key = _keyed(docs)
    spans = free_name(docs, "spans")
    found = secret_scan.find_secrets(_texts(docs, key)).filter(F.size("spans") > 0)
    joined = docs.join(found.select(F.col("doc_id").alias(key), F.col("spans").alias(spans)), key, "left")
    clean = F.col(spans).isNull()
    # Only texts with a secret are handed to Python.
    text = F.when(clean, F.col("text")).otherwise(secret_scan.redact(F.when(~clean, F.col("text")), F.col(spans)))
    joined = joined.withColumn("text", text)
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return joined.select(columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

# A trained model, fingerprints and tokenizers are not SQL; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
