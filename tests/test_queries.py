"""Queries against DuckDB on the small tables."""

import os

import duckdb
import pytest

from lodestone import queries

DIR = "/root/testdata/sf0.001"
SQL = queries.sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, con, name):
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert rows(got).equals(rows(want))


def test_the_legs_overlap(spark):
    rows = queries.merged(spark, DIR).collect()
    both = [r for r in rows if r.distance is not None and r.fts_score is not None]
    assert both and any(r.fts_score is None for r in rows)


def test_results_that_say_something(spark):
    rows = lambda name: queries.QUERIES[name](spark, DIR).collect()
    assert {r.is_query for r in rows("path_query")} == {True, False}
    labels = [r.label for r in rows("render_scores")]
    assert any(x.startswith("score ") for x in labels) and any("(r" in x and "v#" in x for x in labels) and any("(bm25#" in x for x in labels)
    assert rows("path_set_source") and rows("path_set_query") and rows("filter_path")
    hits = rows("service_search")
    assert len(hits) == 10 and any(r.vector_rank and r.lexical_rank for r in hits) and all("/en/" in r.path for r in hits)
