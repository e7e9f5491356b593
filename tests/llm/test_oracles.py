import os

import duckdb
import pytest

from termweave.llm import queries


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for f in os.listdir(medium):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{medium}/{f}'")
    return con


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql_gives_the_same_rows(spark, medium, duck, name):
    got, want = queries.queries()[name](spark, medium), duck.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.project(", ".join(columns)).fetchall())


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
