"""Every registered query equals its DuckDB counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from helixframe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name not in ORACLE_SQL:
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    expected = sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in order) for r in rows), key=key) == expected


def test_every_part_is_asked_for(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert parts > 50 and max(int(r.taxon[6:]) for r in QUERIES["taxonomic_screening"](spark, SF).collect() if r.taxon != "Unknown") > 50


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_corpus_package():
    from pathlib import Path

    root = Path(entry.__file__).parent / "helixframe"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
