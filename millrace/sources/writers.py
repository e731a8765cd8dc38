"""Writers: wide-column cells, text results, vertices, edge lists and similarity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import decimal_format, six_places
from millrace.plans.state import parts_for

FAMILY = "res"
#: What an unreached vertex's distance is written as.
UNREACHED = 2147483647


def _cells(rows: DataFrame, key: Column, cells: list[tuple[Column, Column]]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(q.cast("string").alias("qualifier"), v.cast("string").alias("value")) for q, v in cells])).alias("c")
    return rows.select(key.cast("string").alias("row_key"), pairs).select("row_key", F.lit(FAMILY).alias("family"), "c.qualifier", "c.value")


def cells_of_join(matches: DataFrame, key: str, ordinal: str, columns: dict[str, str]) -> DataFrame:
    """A cell for each output column of each match: the qualifier is the column's spec name, with .n for the
    key's n-th further match. columns: spec name -> column."""
    suffix = F.when(F.col(ordinal) > 0, F.concat(F.lit("."), F.col(ordinal).cast("string"))).otherwise(F.lit(""))
    return _cells(matches, F.col(key), [(F.concat(F.lit(q), suffix), F.col(c)) for q, c in columns.items()])


def cells_of_groups(groups: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """A cell for each aggregate of each group: counts as they are, averages with two decimals, maxima as
    32-bit floats. columns: spec name -> column."""
    shown = {q: decimal_format(F.col(c), 2) if q.startswith("avg") else F.col(c).cast("float") if q.startswith("max") else F.col(c) for q, c in columns.items()}
    return _cells(groups, F.col(key), [(F.lit(q), v) for q, v in shown.items()])


def cells_of_rows(rows: DataFrame, rank: str, columns: dict[str, str]) -> DataFrame:
    """A cell for each column of each row, keyed by its rank."""
    return _cells(rows, F.col(rank), [(F.lit(q), F.col(c)) for q, c in columns.items()])


def wide_cells(cells: DataFrame) -> DataFrame:
    """row_key, cells: qualifier -> value."""
    return cells.groupBy("row_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("qualifier", "value")))).alias("cells"))


def write_table(df: DataFrame, name: str = "Result", keep: bool = False) -> None:
    """Makes the table, replacing one of that name; with `keep`, rows are added to it if it exists."""
    df.write.mode("append" if keep else "overwrite").saveAsTable(name)


def write_lines(lines: DataFrame, path: str, overwrite: bool = True) -> None:
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_pairs(df: DataFrame, path: str, sep: str = " ", overwrite: bool = True) -> None:
    """The columns of each row, with `sep` between them; without `overwrite`, an existing path is an error."""
    write_lines(df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")), path, overwrite)


def rank_lines(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.format_string("%d: %s", "id", six_places(F.col("rank"))).alias("value"))


def distance_lines(distances: DataFrame) -> DataFrame:
    return distances.select("id", F.format_string("%d: %d", "id", F.coalesce(F.col("dist").cast("int"), F.lit(UNREACHED))).alias("value"))


def similarity_lines(sim: DataFrame) -> DataFrame:
    """id: { j: sim, ...,} for each vertex that is the smaller one of a pair. Pairs are counted first, and dealt by that
    vertex into parts of about TASK_ROWS: so many lists at once are what a task holds."""
    parts = F.sort_array(F.collect_list(F.struct("b", "sim")))
    sim = sim.where("a < b")
    rows = sim.repartition(parts_for(sim.sparkSession, sim.count()), "a").groupBy(F.col("a").alias("id")).agg(parts.alias("p"))
    return rows.select("id", F.concat(F.format_string("%d: {", "id"), F.array_join(F.transform("p", lambda x: F.format_string(" %d: %s,", x["b"], six_places(x["sim"]))), ""), F.lit("}")).alias("value"))


def write_vertices(lines: DataFrame, path: str, parts: int) -> None:
    """One file per part, which holds the vertices whose id is that modulo `parts`, by id."""
    lines.withColumn("part", F.pmod("id", F.lit(parts))).repartition(parts, "part").sortWithinPartitions("part", "id").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def hash_partition(edges: DataFrame, parts: int) -> DataFrame:
    """edges with part: the source modulo `parts`, plus one."""
    return edges.withColumn("part", (F.pmod("src", F.lit(parts)) + 1).cast("int"))


def edge_headers(edges: DataFrame, parts: int, vertex_count: int | None = None) -> DataFrame:
    """part, vertices, edges: the header of each part: how many of the ids 0 to vertex_count - 1 (by default,
    to the largest id of an edge) fall to it, and its edges."""
    if vertex_count is None:
        vertex_count = edges.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)).alias("m")).first()["m"] + 1
    every = edges.sparkSession.range(parts).select((F.col("id") + 1).cast("int").alias("part"))
    vertices = F.lit(vertex_count // parts).cast("long") + F.when(F.col("part") <= vertex_count % parts, F.lit(1)).otherwise(0)
    counts = hash_partition(edges, parts).groupBy("part").agg(F.count("*").alias("edges"))
    return every.join(counts, "part", "left").select("part", vertices.cast("long").alias("vertices"), F.coalesce("edges", F.lit(0)).alias("edges"))


def write_edges(edges: DataFrame, path: str, parts: int = 1, vertex_count: int | None = None) -> None:
    """A folder part=i for each part of hash_partition, with one file: its vertices, its edges, and then
    `from to [weight]` lines by source."""
    weight = [F.format_string("%s", F.col("weight"))] if "weight" in edges.columns else []
    line = F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), *weight)
    rows = hash_partition(edges, parts).select("part", F.lit(2).alias("kind"), "src", "dst", line.alias("value"))
    head = edge_headers(edges, parts, vertex_count)
    none = F.lit(None).cast("long")
    for kind, c in enumerate(("vertices", "edges")):
        rows = rows.union(head.select("part", F.lit(kind), none, none, F.col(c).cast("string")))
    rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "src", "dst").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def write_similarity(sim: DataFrame, path: str, round_column: str | None = None) -> None:
    """`a b sim` lines; with `round_column`, in one folder for each round (the progress log)."""
    writer = sim.select(*([round_column] if round_column else []), "a", "b", "sim").write.mode("overwrite")
    (writer.partitionBy(round_column) if round_column else writer).csv(path, sep=" ")
