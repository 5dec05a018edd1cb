"""Every registered query runs, and gives the rows of its SQL twin."""

from __future__ import annotations

import pytest
from conftest import LARGER
from oracle import rows_of, twin_of

from sluice import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_twin(spark, name):
    """On ten times the smallest tables: some faults need more rows to show."""
    names, rows = rows_of(QUERIES[name](spark, LARGER))
    twin_names, twin = twin_of(ORACLES[name], LARGER)
    assert names == twin_names
    assert rows == twin
    assert rows or name in {"rate_limited", "error_monitor_rolling", "usage_anomaly", "new_keys_anti"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert df.count() > 0
