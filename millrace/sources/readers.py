"""Readers: delimited tables, edge lists, key pairs, similarity tables and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import number
from millrace.sources.lines import with_lines

#: Fixed values of the public TPC-H schema: each table's columns in order.
TPCH = {
    "region": "r_regionkey int, r_name string, r_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "supplier": "s_suppkey long, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "customer": "c_custkey long, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """The lines of any number of files as column value."""
    return spark.read.text(list(paths))


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|", columns: list[str] | None = None, lines: bool = False) -> DataFrame:
    """A file without header whose lines end in a separator or don't: with or without that, the columns of
    `schema`, or those asked for, once each, in the order asked for; with `lines`, then _file and _line, by which
    the rows of files have an order (see with_lines)."""
    df = spark.read.csv(path, sep=sep, schema=f"{schema}, _end string", quote="", enforceSchema=True, mode="PERMISSIVE")
    df = (with_lines(df) if lines else df).drop("_end")
    return df.select(*dict.fromkeys(columns), *(["_file", "_line"] if lines else [])) if columns else df


def read_keyed(lines: DataFrame, column: str = "value") -> DataFrame:
    """source, destination, time from lines of three tokens whose third is a number; other lines are left out."""
    t = F.filter(F.split(column, "[ \t\n\r\f]+"), lambda w: w != "")
    rows = lines.select(t.alias("t")).where(F.size("t") == 3)
    return rows.select(F.col("t")[0].alias("source"), F.col("t")[1].alias("destination"), number(F.col("t")[2]).alias("time")).where("time IS NOT NULL")


def read_edges(spark: SparkSession, *paths: str, default_weight: float | None = None) -> DataFrame:
    """src, dst, weight from edge lists of `from to [weight]` lines; the two header lines have one token and
    are left out. The weight is `default_weight` where the line has none."""
    t = F.filter(F.split("value", "[ \t]+"), lambda w: w != "")
    rows = spark.read.text(list(paths)).select(t.alias("t")).where(F.size("t") >= 2)
    return rows.select(F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"), F.coalesce(number(F.get("t", F.lit(2))), F.lit(default_weight).cast("double")).alias("weight"))


def read_graph(spark: SparkSession, *paths: str, default_weight: float | None = None) -> DataFrame:
    """src, dst, weight from edge files that begin with a line that counts vertices and one that counts edges, as
    write_edges makes them. The counts hold: ValueError if a file has no such lines, other than so many edges, or a
    line that is no edge, or if an end isn't among the vertices 0, 1, ... that all files together count. Blank lines
    don't matter. All of that is found in one pass of sums by file."""
    t = F.filter(F.split("value", "[ \t]+"), lambda w: w != "")
    rows = with_lines(spark.read.text(list(paths))).select("_file", "_line", t.alias("t")).where(F.size("t") > 0)
    whole = lambda k: F.get("t", F.lit(k)).try_cast("long")
    weight = number(F.get("t", F.lit(2)))
    head = lambda k: F.max(F.when((F.col("_line") == k) & (F.size("t") == 1), whole(0)))
    is_edge = (F.col("_line") > 1) & F.size("t").isin(2, 3) & whole(0).isNotNull() & whole(1).isNotNull() & ((F.size("t") == 2) | weight.isNotNull())
    files = rows.groupBy("_file").agg(head(0).alias("v"), head(1).alias("e"), F.count_if(is_edge).alias("edges"), F.count_if((F.col("_line") > 1) & ~is_edge).alias("bad"), F.max(F.when(is_edge, F.greatest(whole(0), whole(1)))).alias("top"), F.min(F.when(is_edge, F.least(whole(0), whole(1)))).alias("low"))
    files = files.cache()
    try:
        wrong = files.where(F.col("v").isNull() | F.col("e").isNull() | (F.col("e") != F.col("edges")) | (F.col("bad") > 0)).orderBy("_file").first()
        if wrong:
            said = "no counts" if wrong["v"] is None or wrong["e"] is None else f"{wrong['e']} edges"
            raise ValueError(f"{wrong['_file']}: its first two lines say {said}; it has {wrong['edges']}, and {wrong['bad']} lines that are no edges")
        total = files.agg(F.sum("v").alias("v"), F.max("top").alias("top"), F.min("low").alias("low")).first()
        if total["top"] is not None and (total["top"] >= total["v"] or total["low"] < 0):
            raise ValueError(f"the files count {total['v']} vertices, but edges have ends from {total['low']} to {total['top']}")
    finally:
        files.unpersist()
    return rows.where(is_edge).select(whole(0).alias("src"), whole(1).alias("dst"), F.coalesce(weight, F.lit(default_weight).cast("double")).alias("weight"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))


def in_neighbours(edges: DataFrame) -> DataFrame:
    """id, neighbours: the sorted sources of each vertex's in-edges, multi-edges included."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("neighbours"))


def read_similarity(spark: SparkSession, *paths: str) -> DataFrame:
    """a, b, sim from `a b sim` lines."""
    return spark.read.csv(list(paths), sep=" ", schema="a long, b long, sim double")


#: Bytes of a record: two unsigned longs and a double.
RECORD = 24


def read_similarity_records(spark: SparkSession, path: str) -> DataFrame:
    """a, b, sim from files of 24-byte records (two unsigned longs and a double, little-endian), or a folder of
    them; ids must be below 2^63.

    Files are cut into splits at record borders, so a task reads a part of a file, from any store that Spark reads, and
    a row is a record; the bytes are taken apart by expressions. A file that ends within a record is an error when
    it is read."""
    records = spark.sparkContext._jsc.binaryRecords(path, RECORD).rdd()
    raw = DataFrame(spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    rec = raw.select(F.hex("value").alias("r"))
    flip = lambda lo: F.concat(*[F.substring("r", lo + 2 * k, 2) for k in range(7, -1, -1)])
    whole = lambda lo: F.conv(flip(lo), 16, 10).cast("long")
    bits = flip(33)
    high, low = F.conv(F.substring(bits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(bits, 9, 8), 16, 10).cast("double")
    exponent = (F.shiftright(high, 20) % 2048).cast("int")
    fraction = ((high % 1048576) * 4294967296.0 + low) / 4503599627370496.0
    value = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 1023.0))
    return rec.select(whole(1).alias("a"), whole(17).alias("b"), F.when(high >= 2147483648, -value).otherwise(value).alias("sim"))
