"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest
import twins

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = {"m6_selection_comparison"}


@pytest.fixture(scope="module")
def con():
    return twins.connect(SF)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, con, name):
    assert twins.difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["bag_id", "bag_function", "no_adjacent_bldg"]
