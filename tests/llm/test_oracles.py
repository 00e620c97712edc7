"""The training-data queries that SQL can express, against their DuckDB oracles on the smallest test tables."""

import os

import pytest

from tools.oracle_check import compare, duck
from workboard.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(spark, duck(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, msg
