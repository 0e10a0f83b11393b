"""Every query that SQL can express against an independent engine."""

import pytest

from compare import connect, difference
from tallygrove.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, con):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None
