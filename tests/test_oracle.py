"""Every registered query against its oracle SQL."""

import pytest
from oracle import compare, connect

from sward.plans.registry import oracles, queries

QUERIES, ORACLES = queries(), oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = connect(sf_dir)
    yield c
    c.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, sf_dir, con):
    ok, note = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
