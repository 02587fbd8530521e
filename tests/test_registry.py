"""Every registered query against its DuckDB twin, on the smallest data."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_twin(spark, duck, name):
    assert compare(contract.queries()[name](spark, FOLDER), ORACLES[name], duck) == []


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(ORACLES)))
def test_runs_without_twin(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["system", "month", "topic", "title", "n_tickets"]
