"""Queries of llm against their SQL on the smallest tables."""

import pytest

from penstock.llm import queries

from ..oracle import compare, connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    assert compare(spark, connection(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
