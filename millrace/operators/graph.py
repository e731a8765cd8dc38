"""PageRank, shortest paths and edge operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.relational import ranked_rows
from millrace.plans.pregel import PROGRAMS, VertexProgram, pregel, register, vertices_of
from millrace.plans.state import Tables, cut, parts_for


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def simple_edges(edges: DataFrame) -> DataFrame:
    """No loops, and of several edges between two vertices the lightest."""
    return without_loops(edges).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def edges_of_matrix(matrix: list[list[float]]) -> list[tuple[int, int, float]]:
    """(src, dst, weight) of a dense matrix in which -1 is no edge; the diagonal is left out."""
    return [(i, j, float(w)) for i, row in enumerate(matrix) for j, w in enumerate(row) if w != -1 and i != j]


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, tolerance: float = 1e-6, max_steps: int | None = None) -> tuple[DataFrame, int]:
    """(id, rank) and the superstep at which it halted. Ranks begin at 1 and become 0.15 + 0.85 * the sum of
    rank / out-degree over in-edges; the mass of vertices without out-edges is lost. It halts when the last
    superstep changed all ranks by less than `tolerance` in sum, and keeps that superstep's ranks; or after
    `max_steps` updates."""
    return pregel(edges, pagerank_program(tolerance, max_steps), vertices)


@register("pagerank")
def pagerank_program(tolerance: float = 1e-6, max_steps: int | None = None) -> VertexProgram:
    return VertexProgram(
        init={"rank": F.lit(1.0)},
        apply=lambda step, seen: {"rank": F.lit(1.0) if step == 0 else F.lit(0.15) + F.lit(0.85) * F.coalesce("msg", F.lit(0.0))},
        send=F.try_divide("rank", "out_degree"),
        combine=F.sum,
        aggregates={"change": F.sum(F.abs(F.col("rank") - F.col("_rank")))},
        stop=lambda step, seen: step >= 2 and seen["change"] < tolerance or max_steps is not None and step > max_steps,
    )


def sssp(edges: DataFrame, source: int, vertices: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(id, dist): the least sum of non-negative weights from `source`, null if it reaches no path. Only
    vertices that came nearer send. With `max_hops`, paths of more edges don't count."""
    out, _ = pregel(edges, sssp_program(source, max_hops), vertices)
    return out.select("id", "dist")


@register("sssp")
def sssp_program(source: int, max_hops: int | None = None) -> VertexProgram:
    near = F.col("id") == F.lit(source)
    nearer = F.coalesce(F.col("msg").isNotNull() & (F.col("dist").isNull() | (F.col("msg") < F.col("dist"))), F.lit(False))
    return VertexProgram(
        init={"dist": F.lit(None).cast("double"), "moved": F.lit(False)},
        apply=lambda step, seen: {"dist": F.when(near, F.lit(0.0)), "moved": near} if step == 0 else {"dist": F.least("dist", "msg"), "moved": nearer},
        send=F.when(F.col("moved"), F.col("dist") + F.col("weight")),
        combine=F.min,
        halt=lambda step, seen: F.lit(True),
        aggregates={"moved": F.count_if("moved")},
        stop=lambda step, seen: max_hops is not None and step > max_hops or step > 1 and not seen["moved"],
    )


def shortest_paths(edges: DataFrame, source: int, vertices: DataFrame | None = None) -> DataFrame:
    """(id, dist, pred): distances and the vertex before on a shortest path, the smallest of several; null
    where there is none."""
    near = F.col("id") == F.lit(source)
    zero = F.struct(F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred"))
    nearer = F.when(F.col("best").isNull() | (F.col("msg.dist") < F.col("best.dist")) | ((F.col("msg.dist") == F.col("best.dist")) & (F.col("msg.pred") < F.col("best.pred"))), F.col("msg")).otherwise(F.col("best"))
    program = VertexProgram(
        init={"best": F.lit(None).cast("struct<dist:double,pred:bigint>"), "moved": F.lit(False)},
        apply=lambda step, seen: {"best": F.when(near, zero), "moved": near} if step == 0 else {"best": F.when(F.col("msg").isNotNull(), nearer).otherwise(F.col("best")), "moved": F.coalesce(F.col("msg").isNotNull() & (F.col("best").isNull() | (F.col("msg.dist") < F.col("best.dist"))), F.lit(False))},
        send=F.when(F.col("moved"), F.struct((F.col("best.dist") + F.col("weight")).alias("dist"), F.col("id").alias("pred"))),
        combine=F.min,
        halt=lambda step, seen: F.lit(True),
    )
    out, _ = pregel(edges, program, vertices)
    return out.select("id", F.col("best.dist").alias("dist"), F.col("best.pred").alias("pred"))


def paths_back(paths: DataFrame, source: int, target: int | None = None) -> DataFrame:
    """(id, place, vertex) of the whole path from `source` to each vertex that shortest_paths reached (or to
    `target` alone), place counting from 0 at the source. A path of n steps takes n + 1 rows. ValueError if
    predecessors run in a circle, as edges without weight may make them.

    Every vertex learns its ancestor 1, 2, 4, ... steps back by joining the table of jumps with itself, and
    its path's length; ancestors are then put together from the jumps. The joins are as many as the binary digits
    of the longest path, not its vertices."""
    reached = paths.where("dist IS NOT NULL").select("id", "pred")
    jump = cut(reached.select("id", F.when(F.col("id") == F.lit(source), F.col("id")).otherwise(F.col("pred")).alias("up"), F.when(F.col("id") == F.lit(source), 0).otherwise(1).cast("long").alias("n")))
    jumps = [jump]
    while jump.where(F.col("up") != F.lit(source)).limit(1).count():
        far = jump.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("n").alias("_n"))
        if len(jumps) > 62:
            raise ValueError("the predecessors run in a circle")
        jump = cut(jump.join(far, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("n") + F.col("_n")).alias("n")))
        jumps.append(jump)
    # Places back from the end: of 0, then twice as many with every digit.
    ends = jump if target is None else jump.where(F.col("id") == F.lit(target))
    out = ends.select("id", F.col("id").alias("at"), F.lit(0).cast("long").alias("back"), F.col("n").alias("length"))
    for k, j in enumerate(jumps):
        step = j.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        further = out.where(F.col("back") + F.lit(2**k) <= F.col("length")).join(step, F.col("at") == F.col("_id"))
        out = cut(out.union(further.select("id", F.col("_up").alias("at"), (F.col("back") + F.lit(2**k)).alias("back"), "length")))
    return out.select("id", (F.col("length") - F.col("back")).alias("place"), F.col("at").alias("vertex"))


def path_to(paths: DataFrame, source: int, target: int) -> list[int]:
    """The vertices from `source` to `target`, by the predecessors of shortest_paths, however many they are;
    empty if unreached. One vertex's path, so that it fits the caller."""
    rows = paths_back(paths, source, target).collect()
    return [r["vertex"] for r in sorted(rows, key=lambda r: r["place"])]


def run_program(name: str, edges: DataFrame, vertices: DataFrame | None = None, **arguments) -> DataFrame:
    """Runs the registered program of that name; its other arguments are those of the function registered. ValueError
    names the programs there are."""
    if name not in PROGRAMS:
        raise ValueError(f"no program {name!r}; there are {', '.join(sorted(PROGRAMS))}")
    return pregel(edges, PROGRAMS[name](**arguments), vertices)[0]


def _joined(edges: DataFrame) -> DataFrame:
    """u, v, up, down for every two vertices u < v that an edge joins: whether there is one from u to v, and from v to
    u. Loops and further edges don't count."""
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), (F.col("src") < F.col("dst")).alias("up"))
    return ends.groupBy("u", "v").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))


def directed_triangles(edges: DataFrame) -> DataFrame:
    """One row (triangles, cycles, transitive): threes of vertices of which each two are joined, and among the ways
    to choose one edge for each two of them, how many run in a circle and how many don't.

    Vertices are numbered in the order of their degrees, and every pair is kept at its first vertex: so a hub has few
    pairs of its own, and no vertex more than the root of twice the number of edges. A pair takes what follows it in its first
    vertex's list to the list of its second vertex, which it shares with the third vertices of its triangles: a row
    for each pair, not for each wedge, and only triangles become rows."""
    spark = edges.sparkSession
    pairs = cut(_joined(edges))
    degree = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).groupBy("id").agg(F.count("*").alias("deg"))
    place = cut(ranked_rows(degree, F.col("deg"), F.col("id")).select("id", "rank"))
    number = lambda end: place.select(F.col("id").alias(end), F.col("rank").alias(f"p_{end}"))
    ranked = pairs.join(number("u"), "u").join(number("v"), "v")
    # How the first of the two stands to the second: 1 for an edge to it, 2 for one from it, 3 for both.
    ahead, up, down = F.col("p_u") < F.col("p_v"), F.col("up").cast("tinyint"), F.col("down").cast("tinyint")
    way = F.when(ahead, up + down * F.lit(2).cast("tinyint")).otherwise(down + up * F.lit(2).cast("tinyint")).cast("tinyint")
    arcs = ranked.select(F.least("p_u", "p_v").alias("a"), F.greatest("p_u", "p_v").alias("b"), way.alias("way"))
    lists = cut(arcs.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "way"))).alias("l")).select("a", F.col("l.b").alias("to"), F.col("l.way").alias("ways")))
    first = lists.select(F.posexplode("to").alias("k", "b"), "to", "ways")
    rest = lambda c: F.slice(c, F.col("k") + 2, F.size(c))
    first = first.where(F.col("k") + 1 < F.size("to")).select("b", F.get("ways", F.col("k")).alias("ab"), rest("to").alias("to"), rest("ways").alias("ways"))
    parts = parts_for(spark, 2 * (lists.agg(F.sum(F.size("to"))).first()[0] or 0))
    second = lists.select(F.col("a").alias("_b"), F.col("to").alias("_to"), F.col("ways").alias("_ways")).repartition(parts, "_b")
    met = first.repartition(parts, "b").join(second.hint("shuffle_hash"), F.col("b") == F.col("_b"))
    met = met.withColumn("both", F.array_intersect("to", "_to")).where(F.size("both") > 0)
    found = met.select("ab", "to", "ways", "_to", "_ways", F.explode("both").alias("c"))
    way_of = lambda to, ways: F.get(ways, (F.array_position(to, F.col("c")) - 1).cast("int"))
    found = found.select("ab", way_of("to", "ways").alias("ac"), way_of("_to", "_ways").alias("bc"))
    there = {c: F.col(c).bitwiseAND(1).cast("long") for c in ("ab", "ac", "bc")}
    back = {c: F.shiftright(F.col(c).cast("int"), 1).cast("long") for c in ("ab", "ac", "bc")}
    cycles = there["ab"] * there["bc"] * back["ac"] + there["ac"] * back["bc"] * back["ab"]
    ways = (there["ab"] + back["ab"]) * (there["ac"] + back["ac"]) * (there["bc"] + back["bc"])
    zero = F.lit(0).cast("long")
    return found.agg(F.count("*").alias("triangles"), F.coalesce(F.sum(cycles), zero).alias("cycles"), F.coalesce(F.sum(ways - cycles), zero).alias("transitive"))


def core_numbers(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, core): the largest k for which the vertex is in a set of vertices that are each joined to at least k others
    of it, whatever the edges' directions. Loops and further edges don't count.

    Every vertex starts from its degree, and takes the largest k for which k of its neighbours have at least k (their
    h-index), until none changes: that is its core number. A vertex's neighbours are counted by their values before
    they meet, so a hub has a row for each value, not for each neighbour."""
    kept = Tables(edges.sparkSession, "cores")
    pairs = _joined(edges)
    both = kept.write(pairs.select(F.col("u").alias("id"), F.col("v").alias("other")).union(pairs.select(F.col("v").alias("id"), F.col("u").alias("other"))), "pairs")
    ids = (vertices if vertices is not None else vertices_of(edges)).select("id")
    degree = both.groupBy("id").agg(F.count("*").alias("core"))
    state, step = kept.write(ids.join(degree, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core")), "core-0"), 0
    more = Window.partitionBy("id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        seen = both.join(state.select(F.col("id").alias("other"), F.col("core").alias("value")), "other").groupBy("id", "value").agg(F.count("*").alias("n"))
        index = seen.withColumn("n", F.sum("n").over(more)).groupBy("id").agg(F.max(F.least("value", "n")).alias("new"))
        moved = state.join(index, "id", "left").select("id", F.least("core", F.coalesce("new", F.lit(0))).alias("core"), (F.col("core") > F.coalesce("new", F.lit(0))).alias("fell"))
        moved = kept.write(moved, f"core-{step + 1}")
        kept.drop(f"core-{step}")
        state, step = moved, step + 1
        if not state.where("fell").limit(1).count():
            return state.select("id", "core")
