"""Every registered query with equal SQL gives the rows that DuckDB finds in the same tables."""

import os

import pytest

from lodestar.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations", "pages")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    yield con
    con.close()


def test_sql_belongs_to_queries():
    assert set(catalog.SQL) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_sql(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    said = duck.execute(catalog.SQL[name])
    names = [c[0] for c in said.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in found.select(*[f"`{c}`" for c in names]).collect()) == key(said.fetchall())


def test_rows_without_sql(spark):
    ranked = catalog.model_ranking(spark, DATA).collect()
    assert {(r["model"], r["id"]) for r in ranked if r["rank"] == 1} == {("words-256", 0), ("words-512", 0)}
    assert catalog.ann_operating_point(spark, DATA).first()["recall"] >= 0.95


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.1"])
def test_default_recall(spark, data):
    assert catalog.ann_recall(spark, data).first()["recall"] >= 0.9
