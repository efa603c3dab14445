"""Every registered query with SQL agrees with it; the others run and keep their schema."""

import pytest

import compare
from scorebook.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, small, name):
    assert compare.differences(spark, QUERIES[name], ORACLES[name], small) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs_and_keeps_its_schema(spark, small, name):
    df = QUERIES[name](spark, small)
    types = {f.name: f.dataType for f in df.schema.fields}
    assert len(types) == len(df.columns) and all(len(r) == len(types) for r in df.collect())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
