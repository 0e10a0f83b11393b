import pytest

from tallygrove.llm import common


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash."""

    def build(*rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, True) for i, t in rows],
            "doc_id bigint, text string, source string, n_words int, kept boolean",
        )

    return build


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return common.load(spark, sf_dir, "documents")
