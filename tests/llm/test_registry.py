"""Registered queries and the SQL that checks some of them."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from timberline.llm import queries

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = [m[1] for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(map(int, names)) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_checking_sql(spark, name):
    assert compare(spark, connect(SF), SF, name) is None
