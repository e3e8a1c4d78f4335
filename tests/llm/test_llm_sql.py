"""Registered queries against their SQL; the entry adds them all."""

import pytest
from compare import same

import __spark_entry__
from gleaner.llm import queries


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op4_stupid_backoff"}))
def test_matches_sql(spark, sf, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], sf)


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(__spark_entry__.oracle_sql())
