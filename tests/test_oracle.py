"""Every registered query against its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pytest

from millrace.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(spark, duck, sf, made, sql):
    df = made(spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    answer = duck.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf, name):
    same(spark, duck, sf, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    root = Path(__file__).parents[1] / "millrace"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "millrace.llm" not in f.read_text(), os.fspath(f)
