"""Every registered query against its DuckDB oracle on the smallest test tables (the driver checks sf0.01)."""

import os

import pytest

import __spark_entry__ as entry
from tools.oracle_check import compare, duck
from workboard.plans import catalog

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "Tareas" in df.columns
