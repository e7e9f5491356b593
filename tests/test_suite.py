"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from termweave import suite


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


def rows(df, columns):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", suite.queries())
def test_query(spark, small, duck, name):
    got, want = suite.queries()[name](spark, small).toPandas(), duck.sql(suite.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
    assert len(got)


def test_plans(spark, small):
    """A read is one exchange, and only the columns it needs are scanned."""
    plan = suite.queries()["q02_ftgs_int_string"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert "l_linenumber" in plan and "l_comment" not in plan and "l_partkey" not in plan.split("ReadSchema")[1]
    assert "ArrowEval" not in plan and "PythonUDF" not in plan


def test_all_have_sql():
    assert suite.queries().keys() == suite.oracle_sql().keys()
