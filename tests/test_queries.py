"""Every core query against its SQL on the smallest data; those without SQL must run."""

import pytest
from parity import check

from tempestry.plans import inventory, problems, reference  # noqa: F401  (inventory adds to reference)

Q, S = problems.QUERIES | reference.QUERIES, problems.ORACLE | reference.ORACLE


@pytest.mark.parametrize("name", list(Q))
def test_query(spark, root, name):
    check(spark, root, name, Q, S)


def test_entry(spark, root):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
