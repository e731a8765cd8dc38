import duckdb
import pytest

import __spark_entry__ as entry
from millrace.llm import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_all_thirteen_and_the_pipeline():
    names = list(entry.queries())
    assert [n for n in range(1, 14) if sum(x.startswith(f"op{n}_") for x in names) != 1] == [] and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))
