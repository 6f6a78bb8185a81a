"""Every registered query runs; those with a SQL twin agree with it."""

import pytest

from quillspark.plans.catalog import all_plans
from tests.oracle import assert_same

PLANS = all_plans()


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql])
def test_agrees_with_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, PLANS[name].build, PLANS[name].sql)


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if not p.sql])
def test_runs(spark, sf_dir, name):
    """At least one row, no row of nulls only; the values of most are held in test_units."""
    rows = PLANS[name].build(spark, sf_dir).collect()
    assert rows and all(any(x is not None for x in r) for r in rows)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 4
    assert set(contract.oracle_sql()) <= set(contract.queries())
