import math

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(a, b):
    """Equal bags of rows: floats to nine digits."""
    show = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)
    return sorted(tuple(map(show, r)) for r in a) == sorted(tuple(map(show, r)) for r in b)


def compare(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    con = duck.execute(sql)
    assert sorted(d[0] for d in con.description) == cols
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert same([tuple(r) for r in df.select(*cols).collect()], want)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "s1", "r1", "r5"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
