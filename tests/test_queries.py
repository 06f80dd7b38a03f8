"""Every core query with SQL equals it; every other one runs."""

import pytest
from oracle import assert_same

from treeloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
