"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from pagesieve.registry.oracles import all_oracles
from pagesieve.registry.queries import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
