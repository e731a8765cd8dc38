"""Vertex programs whose compute sees all messages of a vertex, not a combined one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.pregel import vertices_of
from millrace.plans.ship import ship
from millrace.plans.state import Tables


@dataclass
class InboxProgram:
    """A vertex program over whole inboxes.

    state: names and types of the state columns, as in "rank double, seen long". init: their values before
    superstep 0, over `id` and `out_degree`. message: the type of a message.
    compute(step, vertices, inbox): pandas frames of a part of the vertices: those that run (id, out_degree, state
    columns), by id, and their messages (id, msg), by id and then msg. It returns the first with new state, and with
    columns `send`, the message along all out-edges (null: none), and `halt`, whether the vertex goes inactive.
    along(send, weight): the message along an edge, from the one sent and the edge's weight.
    """

    state: str
    init: dict[str, Column]
    message: str
    compute: Callable
    along: Callable[[Column, Column], Column] = lambda send, weight: send


def run_inbox(edges: DataFrame, program: InboxProgram, vertices: DataFrame | None = None, max_steps: int | None = None) -> tuple[DataFrame, int]:
    """Runs `program` until no vertex is active and no message was sent, or for `max_steps` supersteps; returns the
    state (id, state columns) and the number of supersteps. Messages arrive in the next superstep; one makes its
    vertex active again, and those to ids that aren't vertices are lost.

    Vertices are dealt into parts by their ids, and a part's vertices meet its messages in one task, as Arrow frames:
    a call of compute for each part, not for each vertex. A vertex's whole inbox has to fit there, since that is what
    the program asks for; where messages can be combined, pregel takes less. Each superstep's state is written to the
    shared folder, and the one before the last dropped."""
    spark = edges.sparkSession
    ship(spark)
    kept = Tables(spark, "inbox")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(4 * parts)).cast("int").alias("part")
    edges = kept.write(edges.select("src", "dst", *(["weight"] if "weight" in edges.columns else [F.lit(0.0).alias("weight")])), "edges")
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    start = (vertices if vertices is not None else vertices_of(edges)).select("id").join(degrees, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    names = list(program.init)
    schema = f"id long, out_degree long, {program.state}, active boolean, ran boolean, send {program.message}"
    first = start.select("id", "out_degree", *[e.alias(n) for n, e in program.init.items()], F.lit(True).alias("active"), F.lit(True).alias("ran"), F.lit(None).cast(program.message).alias("send"))
    state, step = kept.write(first, "state-0"), 0
    columns, compute = ["id", "out_degree", *names, "active", "ran", "send"], program.compute

    def runner(step: int):
        def run(held, inbox):
            import pandas as pd

            if held.empty:  # messages to no vertex of the part
                return pd.DataFrame(columns=columns)
            runs = held["active"] | held["id"].isin(inbox["id"])
            mine = held[runs].sort_values("id", ignore_index=True)
            messages = inbox[inbox["id"].isin(mine["id"])].sort_values(["id", "msg"], ignore_index=True)
            idle = held[~runs].assign(active=False, ran=False, send=None)
            if mine.empty:
                return idle[columns]
            new = compute(step, mine[["id", "out_degree", *names]], messages[["id", "msg"]])
            new = new.assign(active=~new["halt"].astype(bool), ran=True)[columns]
            return new if idle.empty else pd.concat([new, idle[columns]], ignore_index=True)

        return run

    while max_steps is None or step < max_steps:
        sent = state.where("ran AND send IS NOT NULL").join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), program.along(F.col("send"), F.col("weight")).cast(program.message).alias("msg")).where("msg IS NOT NULL")
        groups = [df.withColumn("part", part("id")).groupBy("part") for df in (state, sent)]
        moved = groups[0].cogroup(groups[1]).applyInPandas(runner(step), schema)
        moved = kept.write(moved, f"state-{step + 1}")
        if not moved.where("ran").limit(1).count():
            break
        kept.drop(f"state-{step}")
        state, step = moved, step + 1
    return state.select("id", *names), step

