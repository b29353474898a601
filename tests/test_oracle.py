"""Every registered listings query against its DuckDB SQL on the sf0.001 tables."""

import math
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer orders lineitem".split()
SQL = {k: v for k, v in E.oracle_sql().items() if k in E.QUERIES}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    return con


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return None if math.isnan(x) else x      # exact equality
        return x
    return sorted((tuple(v(r[i]) for i in order) for r in rows), key=repr)


def test_contract():
    q = E.queries()
    assert set(SQL) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["beach_proximity", "mean_price", "listings", "median_price"]
    assert df.count() == 4


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, duck, key):
    df = E.queries()[key](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[key])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert _norm(s_rows, df.columns) == _norm(d_rows, d_cols)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {SQL[key]}").fetchall()}
    assert spark_types == duck_types
