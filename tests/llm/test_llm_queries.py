"""Every training-data query runs on the smallest tables; those with SQL agree with DuckDB."""

import os

import duckdb
import pytest

from leafmill.llm import queries

COLUMNS = {
    "p1_found": ["book_id", "page_num", "cut"], "p2_found": ["book_id", "page_num", "line_num", "kind"], "p3_found": ["book_id_a", "book_id_b"], "p4_found": ["family_key", "field_name", "book_id"],
    "p5_found": ["book_id", "page_num", "language"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "level"],
}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        if name != "p6_ids":
            assert len(rows) == len(set(rows))
    if name in queries.ORACLES:
        found = duck.execute(queries.ORACLES[name])
        at = [[c[0] for c in found.description].index(c) for c in df.columns]
        assert sorted(map(str, rows)) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_every_problem_has_queries():
    assert {q[:2] for q in queries.QUERIES} == {f"p{i}" for i in range(1, 9)}
