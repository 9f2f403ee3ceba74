"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

# The training-data operators are tested in their own folder.
QUERIES, CHECKS = entry.catalog.queries(), entry.catalog.checks()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, small, con, name):
    assert difference(QUERIES[name](spark, small), con, CHECKS[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
