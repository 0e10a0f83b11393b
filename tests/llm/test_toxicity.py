import numpy as np
import pytest

from tallygrove.llm import common
from tallygrove.llm import toxicity as tx


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.1"
    return common.load(spark, folder, "documents"), common.load(spark, folder, "labels")


def test_held_out_accuracy(labelled):
    """Fitted on one half of the labels, judged on the other."""
    documents, labels = labelled
    half = "pmod(xxhash64(doc_id, 'half'), 2) = 0"
    scored = tx.score(documents, tx.fit(documents, labels.filter(half)))
    rows = scored.join(labels.filter(f"NOT ({half})"), "doc_id").toPandas()
    flagged, toxic = rows["p_toxic"] >= tx.THRESHOLD, rows["toxic"] == 1
    assert flagged[~toxic].mean() < 0.01 and flagged[toxic].mean() > 0.8
    order = rows["p_toxic"].rank()
    auc = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    assert ((rows["p_quality"] >= 0.5) == (rows["quality"] == 1)).mean() > 0.9


def rule_table(spark, n=400):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{(i * 7 + k * 13) % 97}x{i % 11}" for k in range(30)] + (["vile"] if toxic else ["nice"]) + [f"id{i}"]
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, 1, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, source string, p_toxic double"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_odd_rows_and_clashing_names(spark):
    documents, labels = rule_table(spark)
    chain = tx.fit(documents, labels)
    extra = spark.createDataFrame(
        [(None, "so VILE, really", "s", 1.0), (7, None, "s", 1.0), (7, "", "s", 1.0), (8, "vile " * 50_000, "s", 1.0), (8, "vile " * 50_000, "s", 1.0)],
        documents.schema,
    )
    p = tx.score(extra, chain).collect()
    assert sorted(str(r["doc_id"]) for r in p) == ["7", "7", "8", "8", "None"]
    kept = tx.reject(extra, chain)
    assert kept.schema == documents.schema and {r["text"] for r in kept.collect()} == {None, ""}
    assert tx.score(extra.filter("false"), chain).count() == 0


def test_labels_null_unknown_repeated_one_sided_or_missing(spark):
    documents, labels = rule_table(spark)
    more = spark.createDataFrame([(0, None, 1), (9999, 1, 1), (None, 1, 1), (0, 1, 1), (0, 1, 0)], labels.schema)
    scored = tx.classify(documents, labels.unionByName(more))
    assert scored.filter("rejected").count() == 100 and scored.count() == 400
    none = tx.classify(documents, labels.filter("false"))
    assert none.filter("rejected").count() == 0 and none.agg({"p_toxic": "max"}).first()[0] == 0
    clean = tx.classify(documents, labels.filter("toxic = 0"))
    assert clean.filter("rejected").count() == 0


def test_sample_is_bounded_and_near_copies_count_once(spark):
    documents, labels = rule_table(spark)
    assert tx.training_rows(documents, labels, tx.CATEGORIES, 50).count() <= 50
    copies = spark.createDataFrame([(i, "the same long text of words " * 5, "x", 0.1) for i in range(30)], documents.schema)
    assert tx.training_rows(copies, labels, tx.CATEGORIES, 500).count() == 1


def test_later_links_use_earlier_ones(spark):
    documents, labels = rule_table(spark)
    chain = tx.fit(documents, labels)
    first, second = chain.links
    assert len(second.weights) == len(second.words) + tx.N_SHAPE + 2 + 1 + 1
    assert len(first.weights) == len(first.words) + tx.N_SHAPE + 2 + 1
    assert np.isfinite(second.weights).all()


def test_a_shared_passage_keeps_training_rows(spark):
    """Half of each text is one passage; copies count once, by the smallest id."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"d{k}x{i}" for i in range(40)) for k in range(60)]
    texts += [texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i == 61)) for i in range(62)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"] for r in tx.training_rows(docs, labels, tx.CATEGORIES, 1000).collect()}
    assert got == {*range(60)}
