"""Every query runs and equals its SQL on the smallest tables."""

import pytest
from helpers import duck, same

from barloom.plans import registry


@pytest.fixture(scope="module")
def db(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, db, name):
    same(registry.QUERIES[name](spark, sf), db.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    """On tables long enough for trailing features; what they build on is compared with loops in test_backtest.py."""
    sf = "/root/testdata/sf0.01"
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
