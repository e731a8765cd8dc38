"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import graph, metrics, relational, simrank, textagg
from millrace.plans.inbox import InboxProgram, run_inbox
from millrace.plans.pregel import VertexProgram, pregel
from millrace.plans.state import parts_for, scratch_path
from millrace.sources import TPCH, CellTable, cells_of_rows, distance_lines, edge_headers, in_neighbours, out_degrees, rank_lines, read_delimited, read_edges, read_graph, read_keyed, read_lines, read_similarity, read_table, similarity_lines, wide_cells, write_edges, write_lines, write_similarity, write_vertices
from millrace.spec import Ref

#: The sample specs of the query language.
JOIN_ORDERS = "R=lineitem S=orders join:R0=S0 res:S1,R1,R5"
JOIN_PARTS = "R=lineitem S=part join:R1=S0 res:S1,S3,R5"
GROUP_SUPPLIERS = "R=lineitem groupby:R2 res:count,max(R5)"
GROUP_CUSTOMERS = "R=orders groupby:R1 res:count,avg(R3)"
DISTINCT_FLAGS = "R=lineitem select:R4,lt,5 distinct:R8,R9"
DISTINCT_PARTS = "R=part select:R5,gt,950 distinct:R2,R3,R4"

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _reader(spark: SparkSession, d: str):
    return lambda name: read_table(spark, d, name)


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])


# Joins ----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS key, o_custkey AS s1, l_partkey AS r1, l_extendedprice AS r5 FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_hash(spark, d):
    return _named(relational.run(JOIN_ORDERS, _reader(spark, d), "hash"), key="key", s1="S1", r1="R1", r5="R5")


@query("SELECT l_partkey AS key, p_name AS s1, p_type AS s3, l_extendedprice AS r5 FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_merge(spark, d):
    return _named(relational.run(JOIN_PARTS, _reader(spark, d), "sort"), key="key", s1="S1", s3="S3", r5="R5")


_CELLS = """
    WITH m AS (SELECT l_orderkey, o_custkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) - 1 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey::VARCHAR AS row_key, 'res' AS family, q || CASE WHEN n > 0 THEN '.' || n ELSE '' END AS qualifier, v AS value
    FROM (SELECT l_orderkey, n, 'S1' AS q, o_custkey::VARCHAR AS v FROM m UNION ALL SELECT l_orderkey, n, 'R1', l_partkey::VARCHAR FROM m UNION ALL SELECT l_orderkey, n, 'R3', l_linenumber::VARCHAR FROM m)"""


@query(_CELLS.format(order="l_linenumber, l_partkey, l_suppkey, o_orderkey"))
def join_cells(spark, d):
    return relational.run_cells("R=lineitem S=orders join:R0=S0 res:S1,R1,R3", _reader(spark, d), "sort", r_order=["l_linenumber", "l_partkey", "l_suppkey"], s_order=["o_orderkey"])


@query(_CELLS.format(order="o_orderkey, l_linenumber, l_partkey, l_suppkey"))
def join_cells_hash(spark, d):
    return relational.run_cells("S=orders R=lineitem join:R0=S0 res:S1,R1,R3", _reader(spark, d), "hash", r_order=["l_linenumber", "l_partkey", "l_suppkey"], s_order=["o_orderkey"])


_LINES = """
    WITH m AS (SELECT l_orderkey, o_custkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) - 1 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_LINES += _CELLS[_CELLS.index("    SELECT l_orderkey::VARCHAR"):]


def _in_files(spark, d, sorted_by: dict[str, list]):
    """A reader of tables that were written as |-separated files, in an order of their own, and are read again by the
    order of their lines alone."""
    folder = scratch_path(spark, "lines")
    for name, by in sorted_by.items():
        df = read_table(spark, d, name)
        line = F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|")) for c in df.columns])
        write_lines(df.repartitionByRange(parts_for(spark, df.count(), 4), *by).sortWithinPartitions(*by).select(line.alias("value")), f"{folder}/{name}")
    schema = lambda name: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read_table(spark, d, name).schema)
    return lambda name: read_delimited(spark, f"{folder}/{name}", schema(name), lines=True)


@query(_LINES.format(order="l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber"))
def join_cells_lines(spark, d):
    """Matches numbered by the order of the lines of R's files, and then of S's."""
    read = _in_files(spark, d, {"lineitem": [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"], "orders": [F.desc("o_totalprice"), "o_orderkey"]})
    return relational.run_cells("R=lineitem S=orders join:R0=S0 res:S1,R1,R3", read, "sort")


@query(_LINES.format(order="o_totalprice DESC, o_orderkey, l_suppkey, l_partkey DESC, l_linenumber"))
def join_cells_lines_hash(spark, d):
    """The same, in the order of S's lines, and then of R's."""
    read = _in_files(spark, d, {"lineitem": ["l_suppkey", F.desc("l_partkey"), "l_linenumber"], "orders": [F.desc("o_totalprice"), "o_orderkey"]})
    return relational.run_cells("R=lineitem S=orders join:R0=S0 res:S1,R1,R3", read, "hash")


@query("SELECT n_name AS r1, r_name AS s1 FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_nation_region(spark, d):
    return _named(relational.run("R=nation S=region join:R2=S0 res:R1,S1", _reader(spark, d), "sort"), r1="R1", s1="S1")


@query("SELECT n_name AS r1, r_name AS s1 FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_delimited(spark, d):
    """The same over |-separated files that end their lines with a separator."""
    folder = scratch_path(spark, "delimited")
    texts = {"nation": ("n_nationkey", "n_name", "n_regionkey"), "region": ("r_regionkey", "r_name")}
    for name, columns in texts.items():
        write_lines(read_table(spark, d, name).select(F.concat(*[F.concat(F.col(c).cast("string"), F.lit("|")) for c in columns], F.lit("no comment|")).alias("value")), f"{folder}/{name}")
    return _named(relational.run("R=nation S=region join:R2=S0 res:R1,S1", lambda name: read_delimited(spark, f"{folder}/{name}", TPCH[name])), r1="R1", s1="S1")


@query("""SELECT c_custkey::VARCHAR AS row_key, 'res' AS family, q AS qualifier, v AS value FROM (SELECT c_custkey, 'R1' AS q, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'R2', coalesce(n, c_nationkey)::VARCHAR FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)
    WHERE c_custkey::VARCHAR >= '10' AND c_custkey::VARCHAR < '5'""")
def cell_table(spark, d):
    """Cells that are put, some of them put again and some deleted, and then a range of keys."""
    cells = CellTable(spark, scratch_path(spark, "cells")).create()
    read = _reader(spark, d)
    cells.put(cells_of_rows(read("customer"), "c_custkey", {"R1": "c_name", "R2": "c_nationkey", "R4": "c_mktsegment"}))
    cells.put(cells_of_rows(read("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", {"R2": "n"}))
    cells.put(cells_of_rows(read("customer"), "c_custkey", {"R4": "c_mktsegment"}).withColumn("value", F.lit(None).cast("string")))
    return cells.scan("10", "5")


# Groups ---------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey AS key, count(*) AS n, max(l_extendedprice) AS max_r5 FROM lineitem GROUP BY 1")
def group_hash(spark, d):
    return _named(relational.run(GROUP_SUPPLIERS, _reader(spark, d), "hash"), key="key", n="count", max_r5="max(R5)")


@query("SELECT o_custkey AS key, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS avg_r3 FROM orders GROUP BY 1")
def group_sort(spark, d):
    return _named(relational.run(GROUP_CUSTOMERS, _reader(spark, d), "sort"), key="key", n="count", avg_r3="avg(R3)")


@query("""SELECT c_mktsegment AS row_key, 'res' AS family, q AS qualifier, v AS value FROM (
    SELECT c_mktsegment, 'count' AS q, count(*)::VARCHAR AS v FROM customer GROUP BY 1 UNION ALL
    SELECT c_mktsegment, 'avg(R3)', printf('%.2f', sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*)) FROM customer GROUP BY 1 UNION ALL
    SELECT c_mktsegment, 'max(R0)', (max(c_custkey)::FLOAT)::VARCHAR FROM customer GROUP BY 1)""")
def group_cells(spark, d):
    return relational.run_cells("R=customer groupby:R4 res:count,avg(R3),max(R0)", _reader(spark, d), "sort")


@query("SELECT l_returnflag AS key, count(*) AS n, min(l_quantity) AS min_r4, sum(l_linenumber)::DOUBLE AS sum_r3 FROM lineitem GROUP BY 1")
def group_sums(spark, d):
    return _named(relational.run("R=lineitem groupby:R8 res:count,min(R4),sum(R3)", _reader(spark, d), "hash"), key="key", n="count", min_r4="min(R4)", sum_r3="sum(R3)")


# Selections and distinct ----------------------------------------------------------------------------------

_FILTERED = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity::FLOAT {op} 5::FLOAT"


def _filter(name: str):
    def f(spark, d):
        return relational.filtered(read_table(spark, d, "lineitem"), Ref("R", 4), name, 5).select("l_orderkey", "l_linenumber", "l_quantity")

    f.__name__ = f"filter_{name}"
    return f


for _name, _op in (("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<=")):
    query(_FILTERED.format(op=_op))(_filter(_name))


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount::FLOAT = 0.05::FLOAT")
def filter_float(spark, d):
    return relational.filtered(read_table(spark, d, "lineitem"), Ref("R", 6), "eq", 0.05).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT DISTINCT l_returnflag AS r8, l_linestatus AS r9 FROM lineitem WHERE l_quantity::FLOAT < 5::FLOAT")
def distinct_hash(spark, d):
    return _named(relational.run(DISTINCT_FLAGS, _reader(spark, d), "hash"), r8="R8", r9="R9")


_RANKED = """SELECT r2, r3, r4, row_number() OVER (ORDER BY r2 || '|' || r3 || '|' || r4 || '|') - 1 AS rank
    FROM (SELECT DISTINCT p_brand AS r2, p_type AS r3, p_size AS r4 FROM part WHERE p_retailprice::FLOAT > 950::FLOAT)"""


@query(_RANKED)
def distinct_sort(spark, d):
    return _named(relational.run(DISTINCT_PARTS, _reader(spark, d), "sort"), r2="R2", r3="R3", r4="R4", rank="rank")


@query(f"""SELECT rank::VARCHAR AS row_key, 'res' AS family, q AS qualifier, v AS value FROM (
    SELECT rank, 'R2' AS q, r2 AS v FROM ({_RANKED}) UNION ALL SELECT rank, 'R3', r3 FROM ({_RANKED}) UNION ALL SELECT rank, 'R4', r4::VARCHAR FROM ({_RANKED}))""")
def distinct_cells(spark, d):
    return relational.run_cells(DISTINCT_PARTS, _reader(spark, d), "sort")


@query(f"""SELECT row_key, to_json(cells) AS cells FROM (SELECT rank::VARCHAR AS row_key, {{'R2': r2, 'R3': r3, 'R4': r4::VARCHAR}} AS cells FROM ({_RANKED}))""")
def distinct_wide(spark, d):
    return wide_cells(relational.run_cells(DISTINCT_PARTS, _reader(spark, d), "sort")).select("row_key", F.to_json("cells").alias("cells"))


# Text -----------------------------------------------------------------------------------------------------


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def word_count(spark, d):
    return textagg.word_count(read_table(spark, d, "documents"), "text")


@query("SELECT 'count of ' || w || ' =' || chr(9) || count(*) AS value FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS w FROM conversations) WHERE w <> '' GROUP BY w")
def word_lines(spark, d):
    return textagg.word_lines(textagg.word_count(read_table(spark, d, "conversations"), "text")).select("value")


@query("SELECT user_id::VARCHAR AS source, event_type AS destination, count(*) AS n, regexp_replace(printf('%.3f', sum(value::DECIMAL(18,2))::DOUBLE / count(*)), '^(-?)0[.]', '\\1.') AS avg FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def pair_stats(spark, d):
    """Over lines of text; where an event has no value, its line lacks the third token and doesn't count."""
    lines = read_table(spark, d, "events").select(F.concat_ws(" ", F.col("user_id").cast("string"), "event_type", F.col("value").cast("decimal(18,2)").cast("string")).alias("value"))
    return textagg.pair_stats(read_keyed(lines).withColumn("time", F.col("time").cast("decimal(18,2)")))


# Graphs ---------------------------------------------------------------------------------------------------


def user_edges(spark, d) -> DataFrame:
    """From a user to the next one with an event of the same type on the same day; every such pair is an edge,
    and its weight is 1 more than the later event's value."""
    by = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = read_table(spark, d, "events").select(F.lag("user_id").over(by).alias("src"), F.col("user_id").alias("dst"), (F.abs("value") + 1).alias("weight"))
    return rows.where("src IS NOT NULL AND src <> dst")


_USERS = """SELECT * FROM (SELECT lag(user_id) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS src, user_id AS dst, abs(value) + 1 AS weight FROM events)
    WHERE src IS NOT NULL AND src <> dst"""


def first_edges(spark, d) -> DataFrame:
    """A sparse graph, all of it: of each user's edges of user_edges, the earliest and the latest (both, if they
    lead to the same user; one, if it is the same event)."""
    by = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = read_table(spark, d, "events").select("ts", "event_id", F.lag("user_id").over(by).alias("src"), F.col("user_id").alias("dst"), (F.abs("value") + 1).alias("weight"))
    edge = F.struct("ts", "event_id", "dst", "weight")
    ends = rows.where("src IS NOT NULL AND src <> dst").groupBy("src").agg(F.min(edge).alias("first"), F.max(edge).alias("last"))
    return ends.select("src", F.explode(F.array_distinct(F.array("first", "last"))).alias("e")).select("src", "e.dst", "e.weight")


_FIRST = """SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY src ORDER BY ts DESC, event_id DESC) AS z FROM (
    SELECT ts, event_id, lag(user_id) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS src, user_id AS dst, abs(value) + 1 AS weight FROM events) WHERE src IS NOT NULL AND src <> dst) WHERE a = 1 OR z = 1"""


@query(f"SELECT dst AS src, src AS dst, weight FROM ({_FIRST})")
def transpose(spark, d):
    return graph.transpose(first_edges(spark, d)).select("src", "dst", "weight")


@query(f"SELECT src, dst, min(weight) AS weight FROM ({_USERS}) WHERE src <> dst GROUP BY 1, 2")
def simple_edges(spark, d):
    return graph.simple_edges(user_edges(spark, d))


@query(f"SELECT src AS id, count(*) AS out_degree FROM ({_USERS}) GROUP BY 1")
def out_degree(spark, d):
    return out_degrees(user_edges(spark, d))


@query(f"SELECT dst AS id, string_agg(src::VARCHAR, ' ' ORDER BY src) AS neighbours FROM ({_FIRST}) GROUP BY 1")
def in_neighbour_lists(spark, d):
    return in_neighbours(first_edges(spark, d)).select("id", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"))


@query(f"""WITH e AS MATERIALIZED ({_USERS}), n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e)
    SELECT p::INT AS part, (n // 4 + CASE WHEN p <= n % 4 THEN 1 ELSE 0 END)::BIGINT AS vertices, (SELECT count(*) FROM e WHERE src % 4 + 1 = p) AS edges FROM range(1, 5) t(p), n""")
def partition_headers(spark, d):
    return edge_headers(user_edges(spark, d), 4)


def _rank_steps(edges: str, n: int) -> str:
    ctes = [f"e AS MATERIALIZED ({edges})", "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY 1)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS rank FROM v)"]
    ctes += [f"r{k} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(sum(r.rank / o.n), 0) AS rank FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN o ON o.src = e.src LEFT JOIN r{k - 1} r ON r.id = e.src GROUP BY 1)" for k in range(1, n + 1)]
    return "WITH " + ",\n".join(ctes)


@query(_rank_steps(_USERS, 10) + " SELECT id, round(rank, 6) AS rank FROM r10")
def pagerank_10(spark, d):
    ranks, _ = graph.pagerank(user_edges(spark, d), max_steps=10, tolerance=0.0)
    return ranks.select("id", F.round("rank", 6).alias("rank"))


def _rank_halt(n: int) -> str:
    steps = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.rank - b.rank)) AS change FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, n + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in range(1, n + 1))
    return f", halt AS (SELECT min(k) AS k FROM ({steps}) WHERE change < 1e-6) SELECT id, round(rank, 6) AS rank, k AS steps FROM ({every}) JOIN halt USING (k)"


@query(_rank_steps(_FIRST, 120) + _rank_halt(120))
def pagerank_converged(spark, d):
    ranks, steps = graph.pagerank(first_edges(spark, d))
    return ranks.select("id", F.round("rank", 6).alias("rank"), F.lit(steps - 1).cast("int").alias("steps"))


@query(_rank_steps(_FIRST, 10) + " SELECT id, printf('%d: %f', id, rank) AS value FROM r10")
def pagerank_lines(spark, d):
    return rank_lines(graph.pagerank(first_edges(spark, d), max_steps=10)[0])


@query(_rank_steps(_FIRST, 10) + " SELECT printf('%d: %f', id, rank) AS value FROM r10")
def pagerank_files(spark, d):
    """From edge files with headers to vertex files, and those read again."""
    folder = scratch_path(spark, "graph")
    write_edges(first_edges(spark, d), f"{folder}/edges", 4)
    ranks, _ = graph.pagerank(read_edges(spark, *[f"{folder}/edges/part={k}" for k in range(1, 5)]), max_steps=10)
    write_vertices(rank_lines(ranks), f"{folder}/ranks", 4)
    return read_lines(spark, f"{folder}/ranks/part=*")


def _path_steps(edges: str, n: int, source: int = 0) -> str:
    ctes = [f"e AS MATERIALIZED (SELECT src, dst, min(weight) AS weight FROM ({edges}) GROUP BY 1, 2)", "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", f"d0 AS MATERIALIZED (SELECT {source}::BIGINT AS id, 0.0::DOUBLE AS dist)"]
    ctes += [f"d{k} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT * FROM d{k - 1} UNION ALL SELECT e.dst, p.dist + e.weight FROM d{k - 1} p JOIN e ON e.src = p.id) GROUP BY 1)" for k in range(1, n + 1)]
    return "WITH " + ",\n".join(ctes)


@query(_path_steps(_USERS, 30) + " SELECT v.id, round(dist, 6) AS dist FROM v LEFT JOIN d30 USING (id)")
def sssp(spark, d):
    return graph.sssp(user_edges(spark, d), 0).select("id", F.round("dist", 6).alias("dist"))


@query(_path_steps(_USERS, 2) + " SELECT v.id, printf('%d: %d', v.id, coalesce(floor(dist)::INT, 2147483647)) AS value FROM v LEFT JOIN d2 USING (id)")
def sssp_hops(spark, d):
    return distance_lines(graph.sssp(user_edges(spark, d), 0, max_hops=2))


@query(_path_steps(_FIRST, 30) + " SELECT v.id, round(dist, 6) AS dist FROM v LEFT JOIN d30 USING (id)")
def sssp_files(spark, d):
    """Over weighted edge files, whose headers hold; an edge without weight has none in its line, and is one of
    none that counts."""
    folder = scratch_path(spark, "weighted")
    write_edges(first_edges(spark, d).where("weight IS NOT NULL"), folder, 4, users(spark, d).agg(F.max("id")).first()[0] + 1)
    bare = first_edges(spark, d).where("weight IS NULL").select("src", "dst")
    edges = read_graph(spark, f"{folder}/part=*").union(bare.select("src", "dst", F.lit(None).cast("double")))
    return graph.sssp(edges, 0).select("id", F.round("dist", 6).alias("dist"))


@query(_path_steps(_FIRST, 25) + ", p AS (SELECT e.dst AS id, min(e.src) AS pred FROM e JOIN d25 s ON s.id = e.src JOIN d25 t ON t.id = e.dst WHERE s.dist + e.weight = t.dist AND t.dist > 0 GROUP BY 1) SELECT v.id, dist, coalesce(pred, -1) AS pred FROM v LEFT JOIN d25 USING (id) LEFT JOIN p USING (id)")
def shortest_paths(spark, d):
    return graph.shortest_paths(first_edges(spark, d), 0).withColumn("pred", F.coalesce("pred", F.lit(-1).cast("long")))


_PRED = _path_steps(_FIRST, 25) + ", p AS (SELECT e.dst AS id, min(e.src) AS pred FROM e JOIN d25 s ON s.id = e.src JOIN d25 t ON t.id = e.dst WHERE s.dist + e.weight = t.dist AND t.dist > 0 GROUP BY 1)"


@query("WITH RECURSIVE " + _PRED.removeprefix("WITH ") + ", w AS (SELECT id, id AS vertex, 0 AS back FROM d25 UNION ALL SELECT w.id, p.pred, back + 1 FROM w JOIN p ON p.id = w.vertex) SELECT id, (max(back) OVER (PARTITION BY id) - back)::BIGINT AS place, vertex FROM w")
def path_vertices(spark, d):
    return graph.paths_back(graph.shortest_paths(first_edges(spark, d), 0), 0)


@query(_path_steps(_FIRST, 25) + " SELECT v.id, dist FROM v LEFT JOIN d25 USING (id)")
def program_by_name(spark, d):
    return graph.run_program("sssp", first_edges(spark, d), source=0).select("id", "dist")


def _hops(edges: str, n: int) -> str:
    return _path_steps(edges, n).replace("min(weight) AS weight", "1.0::DOUBLE AS weight")


@query(_hops(_USERS, 30) + " SELECT v.id, coalesce(dist, -1)::INT AS hops FROM v LEFT JOIN d30 USING (id)")
def vertex_program(spark, d):
    """A program of its own: fewest edges from vertex 0, by min messages, ended by votes to halt."""
    near = F.col("id") == 0
    program = VertexProgram(
        init={"hops": F.lit(-1)},
        apply=lambda step, seen: {"hops": F.when(near, F.lit(0)).otherwise(-1) if step == 0 else F.when((F.col("hops") < 0) & F.col("msg").isNotNull(), F.col("msg")).otherwise(F.col("hops")), "fresh": near if step == 0 else (F.col("hops") < 0) & F.col("msg").isNotNull()},
        send=F.when(F.col("fresh"), F.col("hops") + 1),
        combine=F.min,
        halt=lambda step, seen: F.lit(True),
    )
    program.init["fresh"] = F.lit(False)
    return pregel(user_edges(spark, d), program)[0].select("id", "hops")


def _second_steps(n: int) -> str:
    ctes = [f"e AS MATERIALIZED ({_FIRST})", "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "t0 AS MATERIALIZED (SELECT id, (id * 7919 % 1009)::DOUBLE AS value FROM v)"]
    ctes += [f"t{k} AS MATERIALIZED (SELECT t.id, coalesce(m.value, t.value) AS value FROM t{k - 1} t LEFT JOIN (SELECT dst, value FROM (SELECT e.dst, value + weight AS value, row_number() OVER (PARTITION BY e.dst ORDER BY value + weight) AS r FROM e JOIN t{k - 1} s ON s.id = e.src WHERE weight IS NOT NULL) WHERE r = 2) m ON m.dst = t.id)" for k in range(1, n + 1)]
    return "WITH " + ",\n".join(ctes)


@query(_second_steps(4) + " SELECT id, round(value, 6) AS value FROM t4")
def vertex_inbox(spark, d):
    """A program that no combiner expresses: every vertex takes the second smallest of its messages, if it has two."""

    def compute(step, vertices, inbox):
        second = inbox.groupby("id", sort=False)["msg"].nth(1)
        found = dict(zip(inbox.loc[second.index, "id"], second, strict=True))
        value = [found.get(i, v) for i, v in zip(vertices["id"], vertices["value"], strict=True)]
        return vertices.assign(value=value, send=value, halt=False)

    program = InboxProgram("value double", {"value": (F.col("id") * 7919 % 1009).cast("double")}, "double", compute, lambda send, weight: send + weight)
    return run_inbox(first_edges(spark, d), program, max_steps=5)[0].select("id", F.round("value", 6).alias("value"))


@query(f"""WITH e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({_USERS}) WHERE src <> dst), u AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e)
    SELECT (SELECT count(*) FROM u x JOIN u y ON y.u = x.v JOIN u z ON z.u = x.u AND z.v = y.v) AS triangles,
        (SELECT count(*) // 3 FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst AND z.dst = x.src)::BIGINT AS cycles,
        (SELECT count(*) FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst) AS transitive""")
def directed_triangles(spark, d):
    return graph.directed_triangles(user_edges(spark, d))


def _core_steps(n: int) -> str:
    ctes = [f"e AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT src AS id, dst AS other FROM ({_FIRST}) UNION ALL SELECT dst, src FROM ({_FIRST})) WHERE id <> other)", "c0 AS MATERIALIZED (SELECT id, count(*) AS core FROM e GROUP BY 1)"]
    ctes += [f"c{k} AS MATERIALIZED (SELECT id, max(least(core, r)) AS core FROM (SELECT e.id, c.core, row_number() OVER (PARTITION BY e.id ORDER BY c.core DESC) AS r FROM e JOIN c{k - 1} c ON c.id = e.other) GROUP BY 1)" for k in range(1, n + 1)]
    return "WITH " + ",\n".join(ctes)


@query(_core_steps(40) + " SELECT id, core FROM c40")
def core_numbers(spark, d):
    return graph.core_numbers(first_edges(spark, d))


# SimRank --------------------------------------------------------------------------------------------------


def users(spark, d) -> DataFrame:
    return read_table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()


def _sim_steps(n: int, matrix: bool) -> str:
    ctes = [f"e AS MATERIALIZED ({_FIRST})", "q AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / any_value(n) AS share FROM e JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) USING (dst) GROUP BY 1, 2)"]
    unit = "SELECT DISTINCT user_id AS a, user_id AS b, 1.0::DOUBLE AS sim FROM events"
    ctes.append(f"s0 AS MATERIALIZED (SELECT a, b, sim * (1 - 0.8::DOUBLE) AS sim FROM ({unit}))" if matrix else f"s0 AS MATERIALIZED ({unit})")
    for k in range(1, n + 1):
        half = f"SELECT s.a, y.dst AS b, sum(s.sim * y.share) AS sim FROM s{k - 1} s JOIN q y ON y.src = s.b GROUP BY 1, 2"
        step = f"SELECT x.dst AS a, h.b, 0.8 * sum(h.sim * x.share) AS sim FROM ({half}) h JOIN q x ON x.src = h.a GROUP BY 1, 2"
        ctes.append(f"s{k} AS MATERIALIZED (" + (f"SELECT a, b, sum(sim) AS sim FROM ({step} UNION ALL SELECT a, b, sim * (1 - 0.8::DOUBLE) FROM ({unit})) GROUP BY 1, 2" if matrix else f"SELECT * FROM ({step}) WHERE a <> b UNION ALL {unit}") + ")")
    return "WITH " + ",\n".join(ctes)


def _sim_halt(n: int) -> str:
    steps = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(coalesce(x.sim, 0) - coalesce(y.sim, 0))) AS change FROM (SELECT * FROM s{k} WHERE a < b) x FULL JOIN (SELECT * FROM s{k - 1} WHERE a < b) y USING (a, b)" for k in range(1, n + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM s{k}" for k in range(1, n + 1))
    return f", halt AS (SELECT coalesce(min(k), {n}) AS k FROM ({steps}) WHERE coalesce(change, 0) <= 1e-6) SELECT a, b, round(sim, 6) AS sim, k AS steps FROM ({every}) JOIN halt USING (k) WHERE a < b"


@query(_sim_steps(3, False) + " SELECT a, b, round(sim, 6) AS sim FROM s3 WHERE a < b")
def simrank_3(spark, d):
    return simrank.simrank(first_edges(spark, d), users(spark, d), 0.8, max_steps=3, tolerance=0.0)[0].select("a", "b", F.round("sim", 6).alias("sim"))


@query(_sim_steps(3, True) + " SELECT a, b, round(sim, 6) AS sim FROM s3")
def simrank_matrix_3(spark, d):
    return simrank.simrank_matrix(first_edges(spark, d), users(spark, d), 0.8, max_steps=3, tolerance=0.0)[0].select("a", "b", F.round("sim", 6).alias("sim"))


@query(_sim_steps(100, False) + _sim_halt(100))
def simrank_converged(spark, d):
    sim, changes = simrank.simrank_blocks(first_edges(spark, d), users(spark, d), 0.8)
    return sim.select("a", "b", F.round("sim", 6).alias("sim"), F.lit(len(changes)).alias("steps"))


@query(_sim_steps(5, False) + " SELECT a, b, round(sim, 6) AS sim, 5 AS steps FROM s5 WHERE a < b")
def simrank_blocks(spark, d):
    """The same similarity on packed blocks."""
    sim, changes = simrank.simrank_blocks(first_edges(spark, d), users(spark, d), 0.8, max_steps=5, tolerance=0.0)
    return sim.select("a", "b", F.round("sim", 6).alias("sim"), F.lit(len(changes)).alias("steps"))


def nation_edges(spark, d) -> DataFrame:
    """From each customers' nation to the suppliers' nations of its earliest and its latest line of an order."""
    read = _reader(spark, d)
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", F.col("c_nationkey").cast("long").alias("src"))
    lines = read("lineitem").join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", F.col("s_nationkey").cast("long").alias("dst"))
    line = F.struct("o_orderdate", "l_orderkey", "l_linenumber", "dst")
    ends = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("src").agg(F.min(line).alias("first"), F.max(line).alias("last"))
    return ends.select("src", F.explode(F.array_distinct(F.array("first", "last"))).alias("e")).select("src", "e.dst")


def nations(spark, d) -> DataFrame:
    return read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


#: One pair after the other: a step of the recursion writes one value of the list of all pairs' values.
_IN_PLACE = """WITH RECURSIVE l AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, o_orderdate, l_orderkey, l_linenumber FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey),
    e AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY o_orderdate, l_orderkey, l_linenumber, dst) AS f, row_number() OVER (PARTITION BY src ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, dst DESC) AS z FROM l) WHERE f = 1 OR z = 1),
    q AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / any_value(n) AS share FROM e JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) USING (dst) GROUP BY 1, 2),
    r AS MATERIALIZED (SELECT x.dst AS a, y.dst AS b, least(x.src, y.src) AS p, greatest(x.src, y.src) AS q, sum(0.8 * x.share * y.share) AS w FROM q x JOIN q y ON x.dst < y.dst GROUP BY 1, 2, 3, 4),
    k AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY a, b) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT a, b FROM r)),
    o AS MATERIALIZED (SELECT k.k, k.n, list({{'w': r.w, 'k': coalesce(v.k, 0), 'one': r.p = r.q}}) AS reads FROM k JOIN r ON r.a = k.a AND r.b = k.b LEFT JOIN k v ON v.a = r.p AND v.b = r.q GROUP BY 1, 2),
    t AS (SELECT 0 AS step, list_transform(range(n), lambda x: 0.0::DOUBLE) AS s FROM (SELECT any_value(n) AS n FROM k)
        UNION ALL SELECT step + 1, list_concat(list_concat(s[1:o.k - 1], [list_sum(list_transform(o.reads, lambda x: x.w * CASE WHEN x.one THEN 1.0 WHEN x.k = 0 THEN 0.0 ELSE list_extract(s, x.k) END))]), s[o.k + 1:]) FROM t JOIN o ON o.k = step % o.n + 1 WHERE step < o.n * {sweeps})
    SELECT a, b, round(list_extract(s, k), 6) AS sim, {sweeps} AS steps FROM k JOIN t ON step = n * {sweeps} WHERE list_extract(s, k) > 0"""


@query(_IN_PLACE.format(sweeps=3))
def simrank_in_place(spark, d):
    """Three sweeps that read what they have written."""
    sim, steps = simrank.simrank_in_place(nation_edges(spark, d), nations(spark, d), 0.8, max_steps=3, tolerance=0.0)
    return sim.select("a", "b", F.round("sim", 6).alias("sim"), F.lit(steps).alias("steps"))


def _mc_steps(steps: int, rounds: int = 100) -> str:
    """Walks against the edges by the draws of uniform_draw, and where two walkers of a round first meet."""
    ctes = [f"e AS MATERIALIZED (SELECT dst AS src, src AS dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS k FROM ({_FIRST}))", "n AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY 1)"]
    ctes.append(f"w0 AS MATERIALIZED (SELECT walker, r AS round, walker AS spot FROM (SELECT DISTINCT user_id AS walker FROM events), range({rounds}) t(r))")
    ctes += [f"w{k + 1} AS MATERIALIZED (SELECT walker, round, e.dst AS spot FROM w{k} JOIN n ON n.src = spot JOIN e ON e.src = spot AND e.k = ('0x' || substr(md5(concat_ws(':', 1, round, walker, {k})), 1, 12))::BIGINT % n.n)" for k in range(steps)]
    spots = " UNION ALL ".join(f"SELECT {k} AS step, * FROM w{k}" for k in range(1, steps + 1))
    ctes.append(f"p AS MATERIALIZED ({spots})")
    ctes.append("m AS MATERIALIZED (SELECT x.round, x.walker AS a, y.walker AS b, min(x.step) AS step FROM p x JOIN p y ON x.round = y.round AND x.step = y.step AND x.spot = y.spot AND x.walker < y.walker GROUP BY 1, 2, 3)")
    return "WITH " + ",\n".join(ctes)


@query(_mc_steps(5) + " SELECT a, b, round(sum(pow(0.8::DOUBLE, step)) / 100, 6) AS sim FROM m GROUP BY 1, 2")
def simrank_mc(spark, d):
    return simrank.simrank_monte_carlo(graph.transpose(first_edges(spark, d)), users(spark, d), rounds=100, length=6, c=0.8).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_mc_steps(6) + ", s AS (SELECT a, b, round(sum(pow(0.8::DOUBLE, step)) / 100, 6) AS sim FROM m GROUP BY 1, 2) SELECT a, b, sim FROM s UNION ALL SELECT b, a, sim FROM s UNION ALL SELECT DISTINCT user_id, user_id, 1.0::DOUBLE FROM events")
def simrank_mc_meeting(spark, d):
    return simrank.simrank_monte_carlo_meeting(first_edges(spark, d), users(spark, d), rounds=100, length=6, c=0.8).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_sim_steps(5, False) + " SELECT a AS id, a || ': {' || string_agg(printf(' %d: %f,', b, sim), '' ORDER BY b) || '}' AS value FROM s5 WHERE a < b AND sim > 0 GROUP BY a")
def simrank_lines(spark, d):
    return similarity_lines(simrank.simrank(first_edges(spark, d), users(spark, d), 0.8, max_steps=5, tolerance=0.0)[0])


@query(_mc_steps(5) + """, t AS (SELECT a, b, sim FROM s20 WHERE a < b), l AS (SELECT r.done AS round, a, b, sum(pow(0.8::DOUBLE, step)) / r.done AS sim FROM (SELECT unnest([25, 50, 75, 100]) AS done) r JOIN m ON m.round < r.done GROUP BY 1, 2, 3),
    c AS (SELECT coalesce(x.round, y.round + 25) AS round, max(abs(coalesce(x.sim, 0) - coalesce(y.sim, 0))) AS update FROM l x FULL JOIN (SELECT * FROM l WHERE round < 100) y ON x.round = y.round + 25 AND x.a = y.a AND x.b = y.b GROUP BY 1),
    g AS (SELECT r.done AS round, sum(abs(coalesce(l.sim, 0) - t.sim)) AS error FROM (SELECT unnest([25, 50, 75, 100]) AS done) r JOIN t ON true LEFT JOIN l ON l.round = r.done AND l.a = t.a AND l.b = t.b GROUP BY 1),
    h AS (SELECT l.round, sum(l.sim) AS error FROM l ANTI JOIN t ON l.a = t.a AND l.b = t.b GROUP BY 1)
    SELECT c.round::INT AS round, round(update, 6) AS update, round((g.error + coalesce(h.error, 0)) / (SELECT count(DISTINCT user_id) FROM events), 6) AS error FROM c JOIN g USING (round) LEFT JOIN h USING (round)""".replace("s20", "(" + _sim_steps(20, False) + " SELECT * FROM s20)"))
def similarity_progress(spark, d):
    """How far the Monte-Carlo log of 25, 50, 75 and 100 rounds is from 20 exact sweeps."""
    edges, ids, log = first_edges(spark, d), users(spark, d), scratch_path(spark, "log")
    simrank.simrank_monte_carlo(graph.transpose(edges), ids, rounds=100, length=6, c=0.8, batch=25, log=log)
    rounds = spark.read.parquet(log)
    truth, changes = simrank.simrank_blocks(edges, ids, 0.8, max_steps=20, tolerance=0.0, pairs=rounds.select("a", "b").distinct())
    return metrics.progress(rounds, truth, ids.count(), 25, whole=sum(changes)).select("round", F.round("update", 6).alias("update"), F.round("error", 6).alias("error"))


# Quality --------------------------------------------------------------------------------------------------


def _two(spark, d) -> tuple[DataFrame, DataFrame]:
    edges, ids = first_edges(spark, d), users(spark, d)
    one = simrank.simrank(edges, ids, 0.8, max_steps=2, tolerance=0.0)[0]
    three = simrank.simrank(edges, ids, 0.8, max_steps=4, tolerance=0.0)[0]
    clean = lambda m: m.select("a", "b", F.round("sim", 6).alias("sim"))
    return clean(one), clean(three)


_TWO = _sim_steps(4, False) + ", x AS MATERIALIZED (SELECT a, b, round(sim, 6) AS sim FROM s2 WHERE a < b), y AS MATERIALIZED (SELECT a, b, round(sim, 6) AS sim FROM s4 WHERE a < b)"


@query(_TWO + " SELECT round(sum(abs(coalesce(x.sim, 0) - coalesce(y.sim, 0))), 6) AS sum_error, round(max(abs(coalesce(x.sim, 0) - coalesce(y.sim, 0))), 6) AS max_error, round(sum(abs(coalesce(x.sim, 0) - coalesce(y.sim, 0))) / greatest((SELECT count(*) FROM x WHERE sim <> 0), (SELECT count(*) FROM y WHERE sim <> 0)), 6) AS error FROM x FULL JOIN y USING (a, b)")
def value_error(spark, d):
    return metrics.value_error(*_two(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("sum_error", "max_error", "error")])


_RANKS = _TWO + ", xr AS (SELECT a, b, row_number() OVER (ORDER BY sim DESC, a, b) - 1 AS rank FROM x), yr AS (SELECT a, b, row_number() OVER (ORDER BY sim DESC, a, b) - 1 AS rank FROM y)"


@query(_RANKS + ", m AS (SELECT least((SELECT count(*) FROM xr), (SELECT count(*) FROM yr)) AS n, abs((SELECT count(*) FROM xr) - (SELECT count(*) FROM yr)) AS d), t AS (SELECT sum(abs(CASE WHEN xr.rank < m.n THEN xr.rank ELSE 0 END - coalesce(yr.rank, 0)))::BIGINT AS displaced FROM xr FULL JOIN yr USING (a, b), m) SELECT displaced, (d * (d - 1) // 2)::BIGINT AS tail, (displaced + d * (d - 1) / 2) / (n + d) AS error, (displaced + d * (d - 1) / 2) * 2 / u.ids / (u.ids + 1) AS error_of_all FROM t, m, (SELECT count(DISTINCT user_id)::DOUBLE AS ids FROM events) u")
def rank_error(spark, d):
    return metrics.rank_error(*_two(spark, d), users(spark, d).count())


@query(_RANKS + " SELECT a, b, rank FROM xr WHERE rank < 20")
def similarity_top(spark, d):
    return metrics.ranked(_two(spark, d)[0], 20).select("a", "b", "rank")


@query(_sim_steps(3, False) + " SELECT a, b, round(sim, 6) AS sim, (row_number() OVER (ORDER BY round(sim, 6) DESC, a, b) - 1)::BIGINT AS rank FROM s3 WHERE a < b")
def similarity_log(spark, d):
    """Ranked similarities from a log of lines."""
    path = scratch_path(spark, "log")
    write_similarity(simrank_3(spark, d), path)
    return metrics.ranked(read_similarity(spark, path))


def flagship(spark, d) -> DataFrame:
    return join_hash(spark, d)
