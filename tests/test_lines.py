import random
import struct

import pytest
from helpers import rows
from pyspark.sql import functions as F

from millrace.operators import relational
from millrace.plans import queries, state
from millrace.sources import read_delimited, read_graph, read_lines, read_similarity_records, with_lines, write_edges


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "4k")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def some_lines(n, seed):
    r = random.Random(seed)
    return ["x" * r.choice([0, 1, 5, 40, 300]) + str(r.random()) for _ in range(n)]


def test_numbers_of_lines(spark, tmp_path, small_splits):
    """Files of many splits, of one, without line end, with blank lines, with a line longer than splits, and empty."""
    files = {"a": some_lines(2000, 1), "b": ["one", "", "", "four"], "c": some_lines(700, 2) + ["y" * 20_000] + some_lines(5, 3), "d": []}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "b" and lines else ""))
    got = with_lines(read_lines(spark, *[str(tmp_path / n) for n in files]))
    splits = {(r["f"], r["s"]) for r in read_lines(spark, str(tmp_path / "a")).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s")).distinct().collect()}
    assert len(splits) > 10
    assert got.columns == ["value", "_file", "_line"]
    want = sorted((v, name, k) for name, lines in files.items() for k, v in enumerate(lines))
    assert sorted((r.value, r["_file"].rpartition("/")[2], r["_line"]) for r in got.collect()) == want
    assert sorted((r["_file"][-1], r["_line"]) for r in got.where("value LIKE '%7'").collect()) == sorted((n, k) for v, n, k in want if v.endswith("7"))


def test_splits_beyond_the_limit_meet_in_a_shuffle(spark, tmp_path, small_splits, monkeypatch):
    from millrace.sources import lines

    (tmp_path / "a").write_text("\n".join(some_lines(900, 4)))
    few = rows(with_lines(read_lines(spark, str(tmp_path / "a"))))
    monkeypatch.setattr(lines, "SPLITS", 0)
    assert rows(with_lines(read_lines(spark, str(tmp_path / "a")))) == few


@pytest.mark.parametrize("how", ["hash", "sort"])
def test_matches_by_the_order_of_lines(spark, tmp_path, small_splits, how):
    """The cells of a join of two files, against a join of their lists of lines."""
    r = random.Random(6)
    left = [(r.randrange(90), f"l{k}") for k in range(1500)]
    right = [(r.randrange(90), f"r{k}") for k in range(400)]
    for name, given in (("R", left), ("S", right)):
        (tmp_path / name).write_text("".join(f"{a}|{b}|\n" for a, b in given))
    read = lambda name: read_delimited(spark, str(tmp_path / name), "k int, v string", lines=True)
    assert read_delimited(spark, str(tmp_path / "R"), "k int, v string", columns=["v"], lines=True).columns == ["v", "_file", "_line"]
    got = {(c.row_key, c.qualifier): c.value for c in relational.run_cells("R=R S=S join:R0=S0 res:R1,S1", read, how).collect()}
    want, seen = {}, {}
    pairs = [(x, y) for x in left for y in right] if how == "sort" else [(x, y) for y in right for x in left]
    for (k, v), (j, w) in pairs:
        if k == j:
            n = seen[k] = seen.get(k, -1) + 1
            end = f".{n}" if n else ""
            want |= {(str(k), f"R1{end}"): v, (str(k), f"S1{end}"): w}
    assert got == want


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2.5), (0, 5, 1.0), (3, 2, 0.25), (3, 2, 0.25), (6, 6, 7.0)], "src long, dst long, weight double")
    write_edges(edges, str(tmp_path / "out"), 3)
    assert rows(read_graph(spark, str(tmp_path / "out/part=*"))) == rows(edges)
    (tmp_path / "g").write_text("4\n3\n0 1\n\n1 2 0.5\n 3  3 1e2 \n\n")
    assert rows(read_graph(spark, str(tmp_path / "g"), default_weight=9.0)) == [(0, 1, 9.0), (1, 2, 0.5), (3, 3, 100.0)]
    (tmp_path / "none").write_text("0\n0\n")
    assert rows(read_graph(spark, str(tmp_path / "none"))) == []


@pytest.mark.parametrize("text", ["4\n3\n0 1\n1 2\n", "4\n1\n0 1\n1 2\n", "2\n1\n0 2\n", "4\n1\n-1 2\n", "0 1\n1 2\n", "4\n2\n0 1\nx y\n", "4\n2\n0 1\n1 2 heavy\n", "4\n2\n0 1\n1 2 3 4\n", "4\n", ""])
def test_graph_files_whose_counts_do_not_hold(spark, tmp_path, text):
    (tmp_path / "ok").write_text("2\n1\n0 1\n")
    (tmp_path / "g").write_text(text)
    if text:
        with pytest.raises(ValueError, match="edges|vertices"):
            read_graph(spark, str(tmp_path / "g"))
    else:
        assert rows(read_graph(spark, str(tmp_path / "ok"), str(tmp_path / "g"))) == [(0, 1, None)]


def test_records_are_read_in_splits(spark, tmp_path):
    """Two files of records, one of several splits; a file that ends within a record."""
    r = random.Random(7)
    cells = [(r.randrange(2**62), k, r.choice([0.0, -0.0, r.gauss(0, 1), 5e-324, -1e300])) for k in range(60_000)]
    (tmp_path / "log").mkdir()
    for name, part in (("a", cells[:50_000]), ("b", cells[50_000:])):
        (tmp_path / "log" / name).write_bytes(b"".join(struct.pack("<QQd", *c) for c in part))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", str(24 * 4096))
    try:
        got = read_similarity_records(spark, str(tmp_path / "log"))
        assert got.select(F.spark_partition_id()).distinct().count() > 10
        assert rows(got) == sorted(cells, key=repr)
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    (tmp_path / "torn").write_bytes(b"x" * 30)
    with pytest.raises(Exception, match="EOFException"):
        read_similarity_records(spark, str(tmp_path / "torn")).count()


@pytest.mark.parametrize("name", ["join_cells_lines", "join_cells_lines_hash"])
def test_files_and_joins_of_lines_grow_in_number(spark, sf_dir, monkeypatch, name):
    """Tables are written as files of about TASK_ROWS lines, and lines are placed by one number over all of them."""
    read, out = queries.read_delimited, []
    monkeypatch.setattr(queries, "read_delimited", lambda spark, path, *a, **b: out.append(path) or read(spark, path, *a, **b))
    want = rows(queries.QUERIES[name](spark, sf_dir))
    monkeypatch.setattr(state, "TASK_ROWS", 500)
    got = queries.QUERIES[name](spark, sf_dir)
    assert len(read_lines(spark, out[-2]).inputFiles()) >= 10
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 10
    assert rows(got) == want


def test_places_over_all_files(spark, tmp_path, small_splits):
    for name, n in (("a", 900), ("b", 0), ("c", 1), ("d", 40)):
        (tmp_path / name).write_text("".join(f"{name}{k:04d}\n" for k in range(n)))
    placed, count = relational._placed(with_lines(read_lines(spark, *[str(tmp_path / n) for n in "abcd"])))
    assert count == 941
    assert [r["_place"] for r in placed.orderBy("value").collect()] == list(range(941))
