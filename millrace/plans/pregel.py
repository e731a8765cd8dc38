"""Bulk-synchronous vertex programs as DataFrame joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.state import cut


@dataclass
class VertexProgram:
    """A vertex program of Column expressions.

    init: state columns of every vertex before superstep 0, over `id` and `out_degree`.
    apply(step, globals): new state over the state columns, `msg` (null if none came) and `out_degree`.
    send: the message along an out-edge over the sender's new state, `id`, `out_degree`, `dst`, `weight`;
        null sends nothing. Each of several equal edges sends.
    post: messages to any vertices, neighbours or not: an array of structs (to, msg) over the same columns but
        `dst` and `weight`. Messages to ids that aren't vertices are lost.
    combine: reduces the messages to a vertex, before the shuffle too.
    halt(step, globals): whether the vertex goes inactive after this superstep (over old state, as `_<name>`,
        and new); a later message makes it active again.
    aggregates: expressions over active vertices (old state as `_<name>`), taken anew in every superstep;
        their values are the next one's globals.
    stop(step, globals): ends the program before superstep `step`.
    """

    init: dict[str, Column]
    apply: Callable[[int, dict], dict[str, Column]]
    send: Column
    combine: Callable[[Column], Column]
    post: Column | None = None
    halt: Callable[[int, dict], Column] = lambda step, seen: F.lit(False)
    aggregates: dict[str, Column] = field(default_factory=dict)
    stop: Callable[[int, dict], bool] = lambda step, seen: False


#: Programs by name; a job can name one of them.
PROGRAMS: dict[str, Callable[..., VertexProgram]] = {}


def register(name: str) -> Callable:
    """Makes a function that returns a program known by `name`."""

    def add(make: Callable[..., VertexProgram]) -> Callable[..., VertexProgram]:
        PROGRAMS[name] = make
        return make

    return add


def vertices_of(edges: DataFrame, count: int | None = None) -> DataFrame:
    """id of every vertex: 0 to count - 1, or all ends of edges."""
    if count is not None:
        return edges.sparkSession.range(count)
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def check_ids(edges: DataFrame, count: int) -> None:
    """ValueError if an edge's end isn't one of 0 to count - 1."""
    if bad := edges.where(~F.col("src").between(0, count - 1) | ~F.col("dst").between(0, count - 1)).limit(1).collect():
        raise ValueError(f"edge {bad[0]['src']} -> {bad[0]['dst']}: ids must be from 0 to {count - 1}")


def pregel(edges: DataFrame, program: VertexProgram, vertices: DataFrame | None = None, max_steps: int | None = None, cut_every: int = 1) -> tuple[DataFrame, int]:
    """Runs `program` until its hook stops it, or no vertex is active and no message was sent; returns the
    state (id, state columns) and the number of supersteps, which only a given `max_steps` limits.

    Edges stay partitioned by source in memory. A superstep is one job: new state, then what the next one
    needs to know in a single row. State is cached, and its lineage is cut every `cut_every` steps: the next
    one names it twice, so an uncut plan doubles in every step.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.select("src", "dst", *(["weight"] if "weight" in edges.columns else [F.lit(0.0).alias("weight")])).repartition(n, "src").persist()
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    names = list(program.init)
    start = (vertices if vertices is not None else vertices_of(edges)).join(degrees, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    state = start.select("id", "out_degree", *[e.alias(c) for c, e in program.init.items()], F.lit(True).alias("active"), F.lit(True).alias("ran")).repartition(n, "id")
    seen: dict = {}
    messages, step, held = None, 0, None
    while (max_steps is None or step < max_steps) and not program.stop(step, seen):
        if messages is None:
            inbox = state.withColumn("msg", F.lit(None).cast(_kind(state, edges, program)))
        else:
            inbox = state.join(messages, "id", "left")
        runs = F.col("active") | F.col("msg").isNotNull()
        new = program.apply(step, seen)
        moved = inbox.select("id", "out_degree", runs.alias("ran"), *[F.col(c).alias(f"_{c}") for c in names], *[F.when(runs, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in names])
        halted = program.halt(step, seen)
        moved = moved.withColumn("active", F.col("ran") & ~halted)
        moved = moved.persist()
        row = moved.agg(F.count_if(F.col("ran")).alias("ran"), *[e.alias(c) for c, e in program.aggregates.items()]).first()
        if held is not None:
            held.unpersist()
        held, state = moved, moved.select("id", "out_degree", *names, "active", "ran")
        if (step + 1) % cut_every == 0:
            state = cut(state, cached=True)
        if not row["ran"]:  # nobody was active, and no message came
            break
        seen = {c: row[c] for c in program.aggregates}
        outbox = state.where("ran").join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("to"), program.send.alias("msg"))
        if program.post is not None:
            outbox = outbox.union(state.where("ran").select(F.explode(program.post).alias("p")).select("p.to", "p.msg"))
        outbox = outbox.where("msg IS NOT NULL")
        messages = outbox.groupBy(F.col("to").alias("id")).agg(program.combine(F.col("msg")).alias("msg"))
        step += 1
    out = cut(state.select("id", *names))
    if held is not None:
        held.unpersist()
    edges.unpersist()
    return out, step


def _kind(state: DataFrame, edges: DataFrame, program: VertexProgram) -> str:
    sent = state.join(edges, F.col("id") == F.col("src")).select(program.send.alias("msg"))
    return sent.groupBy().agg(program.combine(F.col("msg")).alias("msg")).schema["msg"].dataType.simpleString()
