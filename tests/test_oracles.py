"""Every registered query against its SQL in DuckDB; queries without SQL give rows."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from whetstone import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _rows(df):
    def one(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return "None"
        if isinstance(v, float) and not math.isinf(v):
            return str(int(v)) if round(v, 6) == int(v) else str(round(v, 6))
        return str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, duck):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    if name in registry.oracle_sql():
        assert _rows(got) == _rows(duck.sql(registry.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pushdown(spark, sf_dir):
    plan = registry.queries()["s1_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,49.0)]" in plan
    assert "l_extendedprice" not in plan
