import struct

from helpers import rows
from pyspark.sql import functions as F

from millrace.operators.textagg import pair_stats, word_count, word_lines
from millrace.sources import TPCH, distance_lines, edge_headers, hash_partition, in_neighbours, out_degrees, rank_lines, read_delimited, read_edges, read_keyed, read_lines, read_similarity, read_similarity_records, similarity_lines, write_edges, write_pairs, write_similarity, write_vertices
from millrace.streaming import start, stream_lines, stream_pair_stats


def test_delimited(spark, tmp_path):
    (tmp_path / "r.tbl").write_text("0|AFRICA|a \"quoted\" one|\n1|ASIA||\n2|EUROPE|no end\n")
    got = read_delimited(spark, str(tmp_path / "r.tbl"), TPCH["region"])
    assert got.columns == ["r_regionkey", "r_name", "r_comment"] and got.count() == 3
    assert rows(read_delimited(spark, str(tmp_path / "r.tbl"), TPCH["region"], columns=["r_name", "r_regionkey", "r_name"]))[0] == ("AFRICA", 0)
    assert got.where("r_regionkey = 0").first().r_comment == 'a "quoted" one'


def test_edges(spark, tmp_path):
    (tmp_path / "g").write_text("4\n5\n0 1 2.5\n0 2 1\n1 2\n1 2\n3 3 7\n")
    e = read_edges(spark, str(tmp_path / "g"), default_weight=1.0)
    assert rows(e) == [(0, 1, 2.5), (0, 2, 1.0), (1, 2, 1.0), (1, 2, 1.0), (3, 3, 7.0)]
    assert rows(out_degrees(e)) == [(0, 2), (1, 2), (3, 1)]
    assert rows(in_neighbours(e)) == [(1, [0]), (2, [0, 1, 1]), (3, [3])]
    assert rows(hash_partition(e, 2).select("src", "part").distinct()) == [(0, 1), (1, 2), (3, 2)]
    assert rows(edge_headers(e, 2)) == [(1, 2, 2), (2, 2, 3)] and rows(edge_headers(e, 3, 8)) == [(1, 3, 3), (2, 3, 2), (3, 2, 0)]
    write_edges(e, str(tmp_path / "out"), 2)
    (file,) = (tmp_path / "out/part=2").glob("part-*.txt")
    assert file.read_text().splitlines() == ["2", "3", "1 2 1.0", "1 2 1.0", "3 3 7.0"]
    assert rows(read_edges(spark, str(tmp_path / "out/part=1"), str(tmp_path / "out/part=2"))) == rows(e)
    write_edges(e.select("src", "dst"), str(tmp_path / "bare"), vertex_count=4)
    assert read_lines(spark, str(tmp_path / "bare")).count() == 7
    assert rows(read_edges(spark, str(tmp_path / "bare"), default_weight=1.0).select("src", "dst")) == rows(e.select("src", "dst"))


def test_six_places_are_those_of_c(spark):
    """Ties of the shortest decimal text, which the double's exact value lies below, on or above."""
    values = [k / 1e7 for k in range(5, 20_000_000, 99_990)] + [0.6929375, 0.5, 2.0**-7, 3 * 2.0**-7, 0.0, 123456789.0000005]
    r = spark.createDataFrame(list(enumerate(values)), "id long, rank double")
    assert dict(rows(rank_lines(r))) == {i: f"{i}: {v:f}" for i, v in enumerate(values)}
    s = spark.createDataFrame([(0, i + 1, v) for i, v in enumerate(values)], "a long, b long, sim double")
    assert similarity_lines(s).first()["value"] == "0: {" + "".join(f" {i + 1}: {v:f}," for i, v in enumerate(values)) + "}"


def test_vertex_lines(spark, tmp_path):
    r = spark.createDataFrame([(0, 1.5), (1, 0.15)], "id long, rank double")
    assert rows(rank_lines(r)) == [(0, "0: 1.500000"), (1, "1: 0.150000")]
    d = spark.createDataFrame([(0, 7.9), (1, None)], "id long, dist double")
    assert rows(distance_lines(d)) == [(0, "0: 7"), (1, "1: 2147483647")]
    s = spark.createDataFrame([(1, 2, 0.5), (1, 10, 0.25), (3, 1, 9.0)], "a long, b long, sim double")
    assert rows(similarity_lines(s)) == [(1, "1: { 2: 0.500000, 10: 0.250000,}")]
    write_vertices(rank_lines(r), str(tmp_path / "v"), 2)
    assert rows(spark.read.text(str(tmp_path / "v/part=1"))) == [("1: 0.150000",)]


def test_similarity(spark, tmp_path):
    cells = [(0, 1, 0.5), (2, 7, 1e-7), (3, 9, 0.3), (4, 4, 0.0), (5, 6, -2.75)]
    s = spark.createDataFrame(cells, "a long, b long, sim double")
    write_similarity(s, str(tmp_path / "s"))
    assert rows(read_similarity(spark, str(tmp_path / "s"))) == sorted(cells)
    write_similarity(s.withColumn("round", F.lit(3)), str(tmp_path / "log"), "round")
    assert rows(read_similarity(spark, str(tmp_path / "log/round=3"))) == sorted(cells)
    (tmp_path / "bin").write_bytes(b"".join(struct.pack("<QQd", *c) for c in cells))
    assert rows(read_similarity_records(spark, str(tmp_path / "bin"))) == sorted(cells)


def test_text(spark, tmp_path):
    (tmp_path / "t").write_text("a b  A\n\n\tb a\n")
    got = word_count(read_lines(spark, str(tmp_path / "t")))
    assert rows(got) == [("A", 1), ("a", 2), ("b", 2)]
    assert ("a", "count of a =\t2") in rows(word_lines(got))
    (tmp_path / "p").write_text("x y 1.5\nx y 2\nx z nope\nx y\nx y 3 4\n z x .0625\n")
    pairs = pair_stats(read_keyed(read_lines(spark, str(tmp_path / "p"))))
    assert rows(pairs) == [("x", "y", 2, "1.750"), ("z", "x", 1, ".062")]
    write_pairs(pairs, str(tmp_path / "o"))
    assert rows(read_lines(spark, str(tmp_path / "o"))) == [("x y 2 1.750",), ("z x 1 .062",)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1").write_text("x y 1\nbad\n")
    q = start(stream_pair_stats(stream_lines(spark, str(tmp_path / "in"))), "pairs", str(tmp_path / "state"))
    try:
        q.processAllAvailable()
        (tmp_path / "in/2").write_text("x y 2\nu v 3\n")
        q.processAllAvailable()
        assert rows(spark.table("pairs")) == [("u", "v", 1, "3.000"), ("x", "y", 2, "1.500")]
    finally:
        q.stop()
