"""Every query of the library against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lexloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_parity(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_and_plans(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    plan = e.queries()["lang_stats"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<text:string,lang:string>" in plan
    plan = e.queries()["noun_analysis_top3"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
