"""Every query next to its checking SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog import oracles, queries
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_checking_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    assert compare(spark, db, SF_DIR, name) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
