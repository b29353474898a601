"""Training-data queries that SQL can express, against DuckDB on whole tables."""

import pytest

from staylens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import as_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    names, rows = oracle(ORACLE_SQL[name], SF)
    assert sorted(got.columns) == names
    mine = as_rows([tuple(r) for r in got.collect()], got.columns)
    assert mine == rows and rows
