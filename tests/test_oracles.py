"""Every query of the core against its SQL on the smallest tables, and a run of those without SQL."""

import os

import pytest

import oracle
from marlspike import registry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert oracle.compare(registry.QUERIES[name](spark, DATA), con, registry.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0
