"""Every query with an oracle equals it; every other query runs and has a stable schema."""

from __future__ import annotations

import os

import oracle
import pytest

from partsight import plans

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    assert oracle.compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns == QUERIES[name](spark, SF_DIR).columns
    assert df.count() > 0


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
