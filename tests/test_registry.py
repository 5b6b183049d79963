"""Every registered query against its DuckDB oracle on the smallest given tables."""

import os

import pytest

from __spark_entry__ import LLM_QUERIES, entry, oracle_sql, queries
from checks.compare import compare, compare_types, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(queries()) - set(LLM_QUERIES) == set(oracle_sql()) - set(LLM_QUERIES)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(LLM_QUERIES)))
def test_query_equals_oracle(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    relation = duck.sql(oracle_sql()[name])
    got = df.toPandas()
    assert compare(got, relation.df()) == ""
    types = compare_types(df, relation)
    assert not [t for t in types.split("; ") if t and "timestamp" not in t]
    assert len(got) > 0 or name in {"knowledge_rejects"}


def test_entry(spark):
    assert entry(spark).count() > 0
