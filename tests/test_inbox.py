import random
import statistics

import pytest
from helpers import rows
from pyspark.sql import functions as F

from millrace.plans.inbox import InboxProgram, run_inbox


def edges_of(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")


def median():
    """Made here, so that workers get it whole: they don't find this module."""

    def compute(step, vertices, inbox):
        found = inbox.groupby("id")["msg"].median()
        value = vertices["id"].map(found).fillna(vertices["value"])
        return vertices.assign(value=value, send=value, halt=False)

    return compute


@pytest.mark.parametrize("steps", [1, 2, 4])
def test_medians_of_inboxes(spark, steps):
    """A hub, loops, multi-edges, ids without edges, messages to no vertex."""
    r = random.Random(3)
    edges = [(r.randrange(20), r.randrange(20), r.randint(0, 5)) for _ in range(60)] + [(k, 0, 1) for k in range(20)] + [(1, 99, 0), (4, 4, 2), (4, 4, 2)]
    program = InboxProgram("value double", {"value": F.col("id") * 1.5 + F.col("out_degree")}, "double", median(), lambda send, weight: send + weight)
    got, n = run_inbox(edges_of(spark, edges), program, spark.range(25), max_steps=steps)
    value = {k: k * 1.5 + sum(a == k for a, *_ in edges) for k in range(25)}
    for step in range(steps):
        inbox = {k: [value[a] + w for a, b, w in edges if b == k] if step else [] for k in range(25)}
        value = {k: statistics.median(inbox[k]) if inbox[k] else value[k] for k in range(25)}
    assert n == steps and rows(got) == sorted(((k, v) for k, v in value.items()), key=repr)


def test_halted_vertices_run_again_when_a_message_comes(spark):
    """Fewest edges from 0; it ends by itself, and vertices that nothing reaches keep their state."""

    def hops(step, vertices, inbox):
        first = inbox.groupby("id")["msg"].min()
        near = vertices["id"].map(first)
        fresh = (vertices["hops"] < 0) & (near.notna() | ((vertices["id"] == 0) & (step == 0)))
        value = vertices["hops"].mask(fresh, near.fillna(0)).astype("int64")
        return vertices.assign(hops=value, send=(value + 1).where(fresh), halt=True)

    program = InboxProgram("hops long", {"hops": F.lit(-1).cast("long")}, "long", hops)
    got, n = run_inbox(edges_of(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (0, 2, 1), (2, 3, 1), (5, 4, 1)]), program)
    assert dict(rows(got)) == {0: 0, 1: 1, 2: 1, 3: 2, 4: -1, 5: -1} and n == 3


def test_no_vertices(spark):
    program = InboxProgram("value double", {"value": F.lit(0.0)}, "double", median())
    got, n = run_inbox(edges_of(spark, [(0, 1, 1)]).limit(0), program)
    assert rows(got) == [] and n == 0
