"""Every market query against its SQL, or for rows, on the smallest tables."""

import pytest
from oracle import compare, connect

from tickloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"s5_violations", "c14_walk_forward", "a22_walk_forward_summary", "a16_worst_7_days", "a16_worst_14_days", "t28_chart_patterns", "b3_scheduler_guarded", "b7_regime_routed", "a2_closed_bars_4h", "l11_dynamic_threshold", "l13_train_selection", "l8_weekly_ranks"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    n = compare(catalog.QUERIES[name](spark, FOLDER), con, catalog.SQL[name])
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
