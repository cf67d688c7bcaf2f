"""Every catalogue query against its DuckDB oracle on the sf0.01 tables."""

import pytest

import oracle
from conftest import SF_ORACLE
import docpipe.plans.stored  # noqa: F401 - adds its queries
from docpipe.plans.catalog import REGISTRY

WITH_SQL = sorted(n for n, q in REGISTRY.items() if q.sql)


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_ORACLE)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, con, name):
    q = REGISTRY[name]
    problems = oracle.compare(q.run(spark, SF_ORACLE), con, q.sql)
    assert not problems, problems


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["doc_id", "markdown"]
    assert df.where("doc_id >= 0").count() == 200      # the other rows are fixture cases without a document
    assert set(e.oracle_sql()) <= set(e.queries())
