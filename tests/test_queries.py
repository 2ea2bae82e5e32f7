"""Every query against its SQL on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

from corpusloom import queries as base


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, duck, sf, name):
    got = base.QUERIES[name](spark, sf).toArrow()
    if name not in base.SQL:
        assert got.num_rows > 0
        return
    want = duck.sql(base.SQL[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    got, want = got.select(cols), want.select(cols)
    assert [str(t) for t in got.schema.types] == [str(t) for t in want.schema.types]
    assert got.num_rows == want.num_rows
    names = ", ".join(f'"{c}"' for c in cols)
    con = duckdb.connect()
    con.register("got", got)
    con.register("want", want)
    assert con.sql(f"SELECT count(*) FROM (SELECT {names} FROM got EXCEPT ALL SELECT {names} FROM want)").fetchall() == [(0,)]


def test_no_cartesian_product(spark, sf):
    for name, q in base.QUERIES.items():
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
