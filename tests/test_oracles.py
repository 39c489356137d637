"""Every query outside llm against its SQL on the smallest tables; and that its result says something."""

import pytest

from penstock.plans import queries_model, queries_more, queries_rules, queries_study, queries_terms, queries_text

from .oracle import compare, connection

MODULES = (queries_text, queries_model, queries_rules, queries_study, queries_more, queries_terms)
CASES = [(n, m.QUERIES[n], sql) for m in MODULES for n, sql in m.ORACLES.items()]
#: The smallest tables have no such rows.
MAY_BE_EMPTY = {"heading_lines", "word_limit"}


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_same_rows_as_sql(spark, con, sf, name, query, sql):
    got = compare(spark, con, name, query, sql, sf)
    assert got or name in MAY_BE_EMPTY
    numbers = [v for r in got for k, v in r.asDict().items() if isinstance(v, (int, float)) and not k.endswith("id")]
    assert not numbers or any(numbers) or name in MAY_BE_EMPTY


def test_every_oracle_has_a_query():
    for m in MODULES:
        assert set(m.ORACLES) <= set(m.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
