"""Queries with SQL against DuckDB, and the registration contract."""

import pytest

import oracle
from conftest import SF_ORACLE
from docpipe.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    problems = oracle.compare(QUERIES[name](spark, SF_ORACLE), con, SQL[name])
    assert not problems, problems


def test_registered():
    import __spark_entry__ as e
    names = list(e.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
