"""The text queries against their SQL on the smallest data."""

import pytest

queries = pytest.importorskip("tempestry.llm.queries")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, root, name):
    from parity import check

    check(spark, root, name, queries.QUERIES, queries.ORACLE)
