"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest
from siftspark.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(queries.SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_without_sql(spark):
    assert queries.QUERIES["kmeans_build"](spark, DIR).agg({"chunks": "sum"}).first()[0] == 500
    row = queries.QUERIES["ivf_recall"](spark, DIR).first()
    assert 0 < row["scanned_share"] < 1 and row["recall_at_10"] >= 0.9
