"""The registered SQL gives what the operators give."""

import os

import duckdb
import pytest

from helixframe.llm.queries import ORACLE_SQL, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    expected = sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=str) == expected
