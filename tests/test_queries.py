"""Every core query runs; those with SQL agree with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from leafmill.plans import catalogue


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.ORACLES:
        found = duck.execute(catalogue.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        want = sorted(tuple(value(r[columns.index(c)]) for c in order) for r in found.fetchall())
        assert sorted(tuple(value(r[c]) for c in order) for r in rows) == want


def test_oracles_have_queries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_core_stands_alone():
    """Nothing outside the training-data subpackage imports it."""
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "leafmill.llm" not in path.read_text(), path
