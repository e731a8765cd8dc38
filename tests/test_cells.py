import pytest
from helpers import rows

from millrace.sources import CellTable

SCHEMA = "row_key string, family string, qualifier string, value string"


def cells(spark, *given):
    return spark.createDataFrame([(k, "f", q, v) for k, q, v in given], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return CellTable(spark, str(tmp_path / "cells")).create()


def found(df):
    return [(k, q, v) for k, _, q, v in rows(df)]


def test_the_last_put_counts(spark, table):
    assert table.put(cells(spark, ("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3"))) == 1
    assert table.put(cells(spark, ("a", "x", "0"), ("c", "x", "4"), ("b", "x", None))) == 2
    assert found(table.scan()) == [("a", "x", "0"), ("a", "y", "2"), ("c", "x", "4")]
    assert found(table.get("a")) == [("a", "x", "0"), ("a", "y", "2")] and found(table.get("a", qualifier="y")) == [("a", "y", "2")] and found(table.get("b")) == []
    table.put(cells(spark, ("b", "x", "5")))
    before = rows(table.scan())
    table.compact()
    assert rows(table.scan()) == before and len(table._puts()) == 1
    table.compact()
    assert rows(table.scan()) == before


def test_rows_of_one_put(spark, table):
    table.put(spark.createDataFrame([("a", "f", "x", "9", 1), ("a", "f", "x", "1", 2), ("b", "f", "x", "1", 1), ("b", "f", "x", None, 2)], f"{SCHEMA}, t long"), at="t")
    assert found(table.scan()) == [("a", "x", "1")]
    table.put(cells(spark, ("a", "x", "1"), ("a", "x", "7"), ("c", "x", "1"), ("c", "x", None)))
    assert found(table.scan()) == [("a", "x", "7")]


def test_ranges_are_of_bytes_and_reach_the_files(spark, table):
    keys = ["", "1", "10", "2", "Z", "a", "a\x00", "é", "日", "😀"]
    table.put(cells(spark, *[(k, "x", k or "none") for k in keys]))
    for lo in (None, "10", "a", "é"):
        for hi in (None, "2", "a\x00", "😀"):
            want = [k for k in keys if (lo is None or k.encode() >= lo.encode()) and (hi is None or k.encode() < hi.encode())]
            assert sorted(k for k, *_ in found(table.scan(lo, hi))) == sorted(want)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = table.scan("a", "b", family="f")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(row_key,a)" in plan and "LessThan(row_key,b)" in plan and "EqualTo(family,f)" in plan
    assert found(table.scan(family="g")) == []


def test_files_hold_ranges_of_keys(spark, table):
    table.put(spark.range(4000).selectExpr("format_string('%05d', id) AS row_key", "'f' AS family", "'x' AS qualifier", "repeat('v', 300) AS value").repartition(8))
    from pyspark.sql import functions as F

    files = table._read().groupBy(F.input_file_name()).agg(F.min("row_key"), F.max("row_key")).collect()
    spans = sorted((r[1], r[2]) for r in files)
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True)) and table.scan("00100", "00200").count() == 100


def test_create(spark, table):
    assert table.exists() and found(table.scan()) == []
    table.put(cells(spark, ("a", "x", "1")))
    assert found(table.create().scan()) == [("a", "x", "1")] and found(table.create(again=True).scan()) == []
    table.put(cells(spark, ("a", "x", "1")).limit(0))
    assert found(table.scan()) == []
    with pytest.raises(ValueError):
        CellTable(spark, table.path + "-none").scan()
    with pytest.raises(ValueError):
        table.put(cells(spark, (None, "x", "1")))


def test_a_put_that_was_not_finished_does_not_count(spark, table, tmp_path):
    table.put(cells(spark, ("a", "x", "1")))
    table.put(cells(spark, ("a", "x", "2")))
    (tmp_path / "cells/put=2/_SUCCESS").unlink()
    assert found(table.scan()) == [("a", "x", "1")]
