import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from millrace.operators import graph, metrics, simrank
from millrace.plans import queries, state
from millrace.plans.pregel import PROGRAMS, VertexProgram, check_ids, pregel, vertices_of
from millrace.sources import edge_headers, similarity_lines


def edges_of(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")


def some_edges(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.randint(1, 9)) for _ in range(m)]


def brute_rank(n, edges, tolerance=1e-6):
    out = np.bincount([a for a, *_ in edges], minlength=n)
    rank, step = np.ones(n), 0
    while True:
        new = np.full(n, 0.15)
        for a, b, _ in edges:
            new[b] += 0.85 * rank[a] / out[a]
        step, change, rank = step + 1, np.abs(new - rank).sum(), new
        if change < tolerance:
            return rank, step


def test_pagerank(spark):
    edges = some_edges(12, 40, 1)
    ranks, steps = graph.pagerank(edges_of(spark, edges), spark.range(13))
    want, n = brute_rank(13, edges)
    assert steps == n + 1
    assert np.allclose([r.rank for r in ranks.orderBy("id").collect()], want, atol=1e-12)


def brute_paths(n, edges, source, hops=10**9):
    d = {source: 0.0}
    for _ in range(min(hops, n)):
        new = dict(d)
        for a, b, w in edges:
            if a in d and d[a] + w < new.get(b, 1e18):
                new[b] = d[a] + w
        if new == d:
            break
        d = new
    return d


@pytest.mark.parametrize("hops", [None, 1, 2, 3])
def test_sssp(spark, hops):
    edges = some_edges(25, 50, 2)
    got = {r.id: r.dist for r in graph.sssp(edges_of(spark, edges), 0, spark.range(25), hops).collect()}
    want = brute_paths(25, edges, 0, 10**9 if hops is None else hops)
    assert got == {i: want.get(i) for i in range(25)}


def test_binary_tree_with_hop_limit(spark):
    edges = [(i, c, 2) for i in range(255) for c in (2 * i + 1, 2 * i + 2)]
    got = graph.sssp(edges_of(spark, edges), 0, max_hops=7)
    assert rows(got.where("dist IS NOT NULL").groupBy("dist").count()) == [(float(2 * k), 2**k) for k in sorted(range(8), key=lambda k: repr(float(2 * k)))]


def test_paths(spark):
    matrix = [[0, 7, 9, -1, -1, 14], [7, 0, 10, 15, -1, -1], [9, 10, 0, 11, -1, 2], [-1, 15, 11, 0, 6, -1], [-1, -1, -1, 6, 0, 9], [14, -1, 2, -1, 9, 0]]
    e = edges_of(spark, [*graph.edges_of_matrix(matrix), (7, 6, 1)])
    p = graph.shortest_paths(e, 0)
    assert rows(p.select("id", "dist")) == [(0, 0.0), (1, 7.0), (2, 9.0), (3, 20.0), (4, 20.0), (5, 11.0), (6, None), (7, None)]
    assert graph.path_to(p, 0, 4) == [0, 2, 5, 4] and graph.path_to(p, 0, 6) == [] and graph.path_to(p, 0, 0) == [0]


def test_long_paths(spark):
    """Paths of any length, in a number of joins that grows with its digits."""
    n = 11
    e = edges_of(spark, [(k, k + 1, 1) for k in range(n)] + [(5, 100, 3)])
    p = graph.shortest_paths(e, 0)
    assert graph.path_to(p, 0, n) == list(range(n + 1)) and graph.path_to(p, 0, 100) == [0, 1, 2, 3, 4, 5, 100]
    every = {}
    for r in graph.paths_back(p, 0).collect():
        every.setdefault(r.id, {})[r.place] = r.vertex
    assert all(every[k] == {i: i for i in range(k + 1)} for k in range(n + 1))
    circle = spark.createDataFrame([(0, 0.0, None), (1, 1.0, 2), (2, 1.0, 1)], "id long, dist double, pred long")
    with pytest.raises(ValueError, match="circle"):
        graph.path_to(circle, 0, 1)


def test_program_by_name(spark):
    e = edges_of(spark, some_edges(10, 20, 5))
    assert rows(graph.run_program("sssp", e, spark.range(10), source=0).select("id", "dist")) == rows(graph.sssp(e, 0, spark.range(10)))
    with pytest.raises(ValueError, match="pagerank, sssp"):
        graph.run_program("nothing", e)


def test_edge_tools(spark):
    e = edges_of(spark, [(0, 0, 1), (0, 1, 5), (0, 1, 3)])
    assert rows(graph.transpose(e)) == [(0, 0, 1.0), (1, 0, 3.0), (1, 0, 5.0)]
    assert rows(graph.simple_edges(e)) == [(0, 1, 3.0)]
    assert rows(vertices_of(e)) == [(0,), (1,)]
    check_ids(e, 2)
    with pytest.raises(ValueError, match="0 to 0"):
        check_ids(e, 1)


def brute_simrank(n, edges, c, steps, matrix=False):
    q = np.zeros((n, n))
    for a, b, *_ in edges:
        q[a, b] += 1
    q /= np.maximum(q.sum(axis=0), 1)
    s, unit = np.eye(n) * (1 - c if matrix else 1), np.eye(n)
    for k in range(steps):
        new = c * q.T @ s @ q + ((1 - c) * unit if matrix else 0)
        if not matrix:
            np.fill_diagonal(new, 1)
        change = np.abs(new - s).sum() if matrix else np.abs(np.triu(new - s, 1)).sum()
        s = new
        if change <= 1e-6:
            break
    return s, k + 1


@pytest.mark.parametrize("matrix", [False, True])
def test_simrank(spark, matrix):
    edges = some_edges(8, 14, 3)
    e, v = edges_of(spark, edges), spark.range(9)
    want, steps = brute_simrank(9, edges, 0.6, 100, matrix)
    sim, n = (simrank.simrank_matrix if matrix else simrank.simrank)(e, v, 0.6)
    assert n == steps
    got = np.zeros((9, 9))
    for r in sim.collect():
        got[r.a, r.b] = r.sim
    assert np.allclose(got, want if matrix else np.triu(want, 1), atol=1e-9)
    assert simrank.cell(sim, 0, 100) == 0.0


#: The edges of eight vertices, of which 7 has no in-edge, and the similarities known for them.
SMALL = [(0, 1), (0, 2), (1, 0), (2, 3), (2, 5), (3, 4), (4, 2), (5, 0), (5, 6), (6, 3), (7, 0)]


@pytest.mark.parametrize(("matrix", "c", "steps", "known"), [(False, 0.6, 21, {(1, 2): 0.322451, (3, 5): 0.309370, (0, 6): 0.201720, (4, 6): 0.185622}), (False, 0.8, 34, {(1, 2): 0.460948, (3, 5): 0.440625, (4, 6): 0.352500, (0, 6): 0.277259}), (True, 0.6, 24, {(1, 2): 0.172047, (0, 0): 0.526079}), (True, 0.8, 40, {(1, 2): 0.147361})])
def test_simrank_of_a_known_graph(spark, matrix, c, steps, known):
    sim, n = (simrank.simrank_matrix if matrix else simrank.simrank)(edges_of(spark, [(a, b, 1) for a, b in SMALL]), spark.range(8), c)
    got = {(r.a, r.b): r.sim for r in sim.collect()}
    assert n == steps and all(abs(got[p] - v) < 1e-6 for p, v in known.items()) and not any(7 in p and p != (7, 7) for p in got)


def test_monte_carlo(spark, tmp_path):
    edges = [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1), (2, 4, 1), (3, 0, 1), (4, 0, 1), (1, 4, 1)]
    e, v = edges_of(spark, edges), spark.range(5)
    true, _ = brute_simrank(5, edges, 0.8, 100)
    got = simrank.simrank_monte_carlo(graph.transpose(e), v, rounds=400, length=12, c=0.8, batch=100, log=str(tmp_path / "log"))
    assert rows(got) == rows(simrank.simrank_monte_carlo(graph.transpose(e), v, rounds=400, length=12, c=0.8, batch=100))
    for r in got.collect():
        assert r.a < r.b and abs(r.sim - true[r.a, r.b]) < 0.12
    both = {(r.a, r.b): r.sim for r in simrank.simrank_monte_carlo_meeting(e, v, rounds=400, length=11, c=0.8, batch=100).collect()}
    assert both[0, 0] == 1.0 and all(both[b, a] == s for (a, b), s in both.items()) and {(r.a, r.b): r.sim for r in got.collect()}.items() <= both.items()
    log = spark.read.parquet(str(tmp_path / "log"))
    steps = metrics.progress(log, got, 5, 100)
    assert {r["round"]: r.error for r in steps.collect()}[400] < 1e-12


def test_metrics(spark):
    x = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25), (1, 2, 0.25)], "a long, b long, sim double")
    y = spark.createDataFrame([(0, 2, 0.75), (0, 1, 0.5)], "a long, b long, sim double")
    assert rows(metrics.value_error(x, y)) == [(0.75, 0.5, 0.25)]
    assert rows(metrics.ranked(x).select("a", "b", "rank")) == [(0, 1, 0), (0, 2, 1), (1, 2, 2)]
    assert rows(metrics.ranked(x, 1).select("a", "b")) == [(0, 1)]
    # Lengths 3 and 2: n = 2, d = 1; (0, 1): 0 and 1, (0, 2): 1 and 0, (1, 2) is beyond n.
    assert rows(metrics.rank_error(x, y, 3)) == [(2, 0, 2 / 3, 2 * 2 / 3 / 4)]
    none = x.limit(0)
    assert rows(metrics.value_error(none, none)) == [(0.0, 0.0, 0.0)] and rows(metrics.rank_error(none, none, 3)) == [(0, 0, 0.0, 0.0)]
    assert rows(simrank.add(x, y, -1.0).where(F.abs("sim") > 1e-12)) == [(0, 2, -0.5), (1, 2, 0.25)]
    assert simrank.absolute_sum(simrank.divide(x, 2.0)) == 0.5


def test_messages_to_any_vertex(spark):
    """Every vertex writes to id 0, which adds up; 0 answers 3, which has no edge."""
    program = VertexProgram(
        init={"total": F.lit(0).cast("long")},
        apply=lambda step, seen: {"total": F.col("total") + F.coalesce("msg", F.lit(0))},
        send=F.lit(None).cast("long"),
        combine=F.sum,
        post=F.when(F.col("total") == 0, F.array(F.struct(F.lit(0).cast("long").alias("to"), (F.col("id") + 1).alias("msg")))).when(F.col("id") == 0, F.array(F.struct(F.lit(3).cast("long").alias("to"), F.col("total").alias("msg")), F.struct(F.lit(99).cast("long").alias("to"), F.lit(1).cast("long").alias("msg")))),
        halt=lambda step, seen: F.lit(True),
    )
    out, steps = pregel(edges_of(spark, [(0, 1, 1), (1, 2, 1)]), program, spark.range(4))
    assert rows(out) == [(0, 10), (1, 0), (2, 0), (3, 10)] and steps >= 3
    assert set(PROGRAMS) == {"pagerank", "sssp"}


def test_simrank_queries_take_the_whole_graph(spark, sf_dir):
    edges = [(r.src, r.dst, 1) for r in queries.first_edges(spark, sf_dir).collect()]
    n = queries.users(spark, sf_dir).count()
    true, steps = brute_simrank(n, edges, 0.8, 100)
    five, _ = brute_simrank(n, edges, 0.8, 5)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    got = {(r.a, r.b): (r.sim, r.steps) for r in queries.simrank_converged(spark, sf_dir).collect()}
    assert set(got) == {p for p in pairs if true[p] > 0} and all(abs(sim - true[p]) < 1e-6 and k == steps for p, (sim, k) in got.items())
    lines = {a: "".join(f" {b}: {five[a, b]:f}," for b in range(a + 1, n) if five[a, b] > 0) for a in range(n)}
    assert {r.id: r.value for r in queries.simrank_lines(spark, sf_dir).collect()} == {a: f"{a}: {{{x}}}" for a, x in lines.items() if x}
    for query in (queries.simrank_mc, queries.simrank_mc_meeting):
        near = {(r.a, r.b): r.sim for r in query(spark, sf_dir).collect()}
        assert abs(np.mean([near.get(p, 0.0) - true[p] for p in pairs])) < 0.05


@pytest.mark.parametrize("name", ["pagerank_lines", "simrank_3", "rank_error", "similarity_top", "in_neighbour_lists", "shortest_paths"])
def test_the_graph_of_the_queries_tells_directions_apart(spark, sf_dir, monkeypatch, name):
    """Rows change if edges are turned round."""
    right = rows(queries.QUERIES[name](spark, sf_dir))
    own = queries.first_edges
    monkeypatch.setattr(queries, "first_edges", lambda spark, d: graph.transpose(own(spark, d)))
    assert rows(queries.QUERIES[name](spark, sf_dir)) != right


def test_the_graph_of_the_queries_is_no_complete_one(spark):
    d = "/root/testdata/sf0.01"
    assert len({r.sim for r in queries.simrank_3(spark, d).collect()}) > 100
    assert len({r.value for r in queries.pagerank_lines(spark, d).collect()}) > 100
    assert queries.path_vertices(spark, d).agg(F.max("place")).first()[0] >= 5
    assert queries.rank_error(spark, d).first()["displaced"] > 0


def test_steps_are_unlimited_by_default(spark):
    """Only a given max_steps ends a program whose messages are under way."""
    e = edges_of(spark, [(k, k + 1, 1) for k in range(4)])
    program = VertexProgram(init={"far": F.lit(-1)}, apply=lambda step, seen: {"far": F.when(F.col("id") == 0, 0).otherwise(-1) if step == 0 else F.coalesce("msg", "far")}, send=F.when(F.col("far") >= 0, F.col("far") + 1), combine=F.max, halt=lambda step, seen: F.lit(True))
    assert pregel.__defaults__[1] is None
    assert rows(pregel(e, program)[0]) == rows(pregel(e, program, max_steps=None)[0]) == [(k, k) for k in range(5)]
    assert rows(pregel(e, program, max_steps=2)[0]) == [(0, 0), (1, 1), (2, -1), (3, -1), (4, -1)]


def test_ranks_tell_close_values_apart(spark):
    """Doubles rank as doubles: tiny, large, negative and equal ones."""
    sims = [(0, 1, 1e-14), (0, 2, 3e-14), (0, 3, 5e6), (0, 4, -2.0), (0, 5, 0.0), (0, 10, 0.5), (0, 9, 0.5), (1, 2, 1e-300)]
    got = metrics.ranked(spark.createDataFrame(sims, "a long, b long, sim double"))
    want = sorted(sims, key=lambda x: (-x[2], x[0], x[1]))
    assert [(r.a, r.b, r.sim) for r in got.orderBy("rank").collect()] == want and sorted(r["rank"] for r in got.collect()) == list(range(len(sims)))


@pytest.mark.parametrize(("edges", "want"), [([], [(1, 0, 0), (2, 0, 0)]), ([(0, 0, 1)], [(1, 1, 1), (2, 0, 0)]), ([(0, 1, 1), (1, 0, 1), (2, 0, 1)], [(1, 2, 2), (2, 1, 1)])])
def test_headers_of_parts(spark, edges, want):
    assert rows(edge_headers(edges_of(spark, edges) if edges else edges_of(spark, [(0, 0, 0)]).limit(0), 2)) == want


def brute_in_place(n, edges, c, sweeps=None, tolerance=1e-6):
    back = [[a for a, b, *_ in edges if b == v] for v in range(n)]
    sim, step = np.eye(n), 0
    while True:
        change = 0.0
        for a in range(n):
            for b in range(a + 1, n):
                if back[a] and back[b]:
                    s = c * np.mean([[sim[i, j] for j in back[b]] for i in back[a]])
                    change += abs(s - sim[a, b])
                    sim[a, b] = sim[b, a] = s
        step += 1
        if step == sweeps or change <= tolerance:
            return sim, step


@pytest.mark.parametrize(("edges", "n", "sweeps"), [(some_edges(9, 20, 8), 10, 2), ([*some_edges(7, 12, 9), (3, 3, 1), (3, 3, 1)], 7, 2), ([(0, 1, 1)], 3, 3)])
def test_simrank_in_place(spark, edges, n, sweeps):
    """Every value after a few sweeps: loops, multi-edges, vertices without in-edges, nothing similar."""
    want, steps = brute_in_place(n, edges, 0.8, sweeps)
    sim, got = simrank.simrank_in_place(edges_of(spark, edges), spark.range(n), 0.8, max_steps=sweeps)
    have = {(r.a, r.b): r.sim for r in sim.collect()}
    assert got == steps and set(have) == {(a, b) for a in range(n) for b in range(a + 1, n) if want[a, b] > 0}
    assert all(abs(v - want[p]) < 1e-12 for p, v in have.items())


def test_converged_similarity_leaves_no_sweeps_behind(spark, monkeypatch):
    """Sweeps are tables that are dropped, not checkpoints that stay until the session ends."""
    edges, left, dropped, cut, drop = edges_of(spark, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 4, 1)]), [], [], simrank.cut, simrank.Tables.drop
    monkeypatch.setattr(queries, "first_edges", lambda *_: edges)
    monkeypatch.setattr(queries, "users", lambda *_: spark.range(5).select("id"))
    monkeypatch.setattr(simrank, "cut", lambda df: left.append(df) or cut(df))
    monkeypatch.setattr(simrank.Tables, "drop", lambda self, name="": dropped.append(name) or drop(self, name))
    assert rows(queries.simrank_converged(spark, "")) == [(1, 2, 0.8, 3), (3, 4, 0.64, 3)]
    assert not left and dropped == ["sweep-1", "sweep-2"]


@pytest.mark.parametrize("name", ["simrank_converged", "similarity_progress"])
def test_exact_queries_keep_numbers_of_vertices(spark, monkeypatch, name):
    """A graph whose vertices are all similar: no table of the exact sweeps holds its pairs, and progress asks for
    the similarities of the pairs that met alone."""
    n, sizes, asked, write, exact = 60, {}, [], simrank.Tables.write, simrank.simrank_blocks

    def seen(self, df, name, *by):
        sizes[name] = (out := write(self, df, name, *by)).count()
        return out

    def run(*given, **named):
        asked.append(named.get("pairs"))
        return exact(*given, **named)

    monkeypatch.setattr(queries, "first_edges", lambda *_: edges_of(spark, [(0, k, 1) for k in range(1, n)]))
    monkeypatch.setattr(queries, "users", lambda *_: spark.range(n).select("id"))
    monkeypatch.setattr(simrank.Tables, "write", seen)
    monkeypatch.setattr(simrank, "simrank_blocks", run)
    got = rows(queries.QUERIES[name](spark, ""))
    assert "sweep-1" in sizes and max(sizes.values()) <= n
    if name == "simrank_converged":
        assert len(got) == (n - 1) * (n - 2) // 2 and {r[2:] for r in got} == {(0.8, 2)}
    else:
        assert asked[0] is not None and {r[0] for r in got} == {25, 50, 75, 100} and {r[2] for r in got} == {0.0}


def test_plans_of_levels_do_not_grow(spark, monkeypatch):
    """What a level or a sweep is computed from is a table, however many levels came before."""
    sizes, write = {}, simrank.Tables.write

    def seen(self, df, name, *by):
        sizes[name] = len(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, df, name, *by)

    monkeypatch.setattr(simrank.Tables, "write", seen)
    simrank.simrank_in_place(edges_of(spark, some_edges(9, 20, 8)), spark.range(10), 0.8, max_steps=2, tolerance=0.0)
    levels = max(int(n.partition("-")[2]) for n in sizes if n.startswith("level-")) - 1
    late = max(v for n, v in sizes.items() if n.startswith("sweep-"))
    assert levels >= 5 and late <= 1.5 * sizes["level-2"], (levels, late, sizes["level-2"])


def test_simrank_in_place_takes_fewer_sweeps(spark):
    """12 instead of 21 on the known graph at c = 0.6, to the same values."""
    sim, steps = simrank.simrank_in_place(edges_of(spark, [(a, b, 1) for a, b in SMALL]), spark.range(8), 0.6)
    got = {(r.a, r.b): r.sim for r in sim.collect()}
    assert steps == brute_in_place(8, SMALL, 0.6)[1] == 12
    assert all(abs(got[p] - v) < 1e-6 for p, v in {(1, 2): 0.322451, (3, 5): 0.309370, (0, 6): 0.201720, (4, 6): 0.185622}.items())


def test_crowds_of_walkers(spark, monkeypatch):
    """A hub where nearly all walkers stand, dealt into blocks: the same meetings, and no key with more than a few blocks."""
    edges = edges_of(spark, [(k, 0, 1) for k in range(1, 90)] + [(0, 1, 1), (0, 2, 1), (5, 6, 1)])
    walks = simrank._walks(edges, spark.range(90), range(4), 4, 1).persist()
    whole = rows(simrank._meetings(walks))
    monkeypatch.setattr(simrank, "CROWD", 7)
    assert rows(simrank._meetings(walks)) == whole and len(whole) > 4000
    monkeypatch.setattr(simrank, "CROWD", 1)
    assert rows(simrank._meetings(walks)) == whole
    walks.unpersist()


@pytest.mark.parametrize("method", [simrank.simrank, simrank.simrank_matrix])
def test_similarity_is_dealt_by_counts(spark, monkeypatch, method):
    """Sweeps and lists of many cells get more parts than the session's, whose settings hold afterwards."""
    edges, ids = edges_of(spark, some_edges(40, 120, 9)), spark.range(40)
    found = lambda: method(edges, ids, 0.8, max_steps=2, tolerance=0.0)[0]
    shown = lambda m: rows(m.select("a", "b", F.round("sim", 9)))
    few = found()
    settings = {c: spark.conf.get(c) for c in (state.SHUFFLE, state.COALESCE)}
    monkeypatch.setattr(state, "TASK_ROWS", 20)
    many = found()
    assert {c: spark.conf.get(c) for c in settings} == settings
    assert many.rdd.getNumPartitions() > 30
    assert shown(many) == shown(few) and len(shown(few)) > 500
    lines = similarity_lines(many)
    assert lines.rdd.getNumPartitions() > 20
    assert [r.id for r in lines.orderBy("id").collect()] == sorted({a for a, b, _ in shown(few) if a < b})


def brute_triangles(n, edges):
    e = {(a, b) for a, b, *_ in edges if a != b}
    threes = [(a, b, c) for a in range(n) for b in range(n) for c in range(n) if len({a, b, c}) == 3]
    joined = lambda a, b: (a, b) in e or (b, a) in e
    triangles = sum(a < b < c and joined(a, b) and joined(b, c) and joined(a, c) for a, b, c in threes)
    cycles = sum((a, b) in e and (b, c) in e and (c, a) in e for a, b, c in threes) // 3
    return triangles, cycles, sum((a, b) in e and (b, c) in e and (a, c) in e for a, b, c in threes)


@pytest.mark.parametrize("edges", [some_edges(14, 70, 1), some_edges(20, 60, 2) + [(0, k, 1) for k in range(20)] + [(k, 0, 1) for k in range(5)], [(0, 1, 1), (1, 2, 1)], [(3, 3, 1)]])
def test_directed_triangles(spark, edges):
    assert rows(graph.directed_triangles(edges_of(spark, edges))) == [brute_triangles(20, edges)]


def joined_rows(df):
    """The rows that each join of a frame gave, once it has run."""
    df = df.agg(*[F.sum(c) for c in df.columns])
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif "Join" in kind:
            out.append(node.metrics().get("numOutputRows").get().value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


def test_triangles_join_a_row_for_each_pair(spark):
    """Thirty vertices joined to thirty others have 900 pairs, 13,050 wedges and no triangle."""
    got = graph.directed_triangles(edges_of(spark, [(a, b, 1) for a in range(30) for b in range(30, 60)]))
    assert rows(got) == [(0, 0, 0)]
    made = joined_rows(got)
    assert made and max(made) <= 900


def test_core_numbers(spark):
    edges = some_edges(30, 90, 4) + [(a, b, 1) for a in range(6) for b in range(6)] + [(29, k, 1) for k in range(29)] + [(30, 31, 1), (31, 30, 1)]
    near = {v: {b for a, b, *_ in edges if a == v} | {a for a, b, *_ in edges if b == v} for v in range(33)}
    core, left = {}, {v: x - {v} for v, x in near.items()}
    k = 0
    while left:
        k += 1
        while gone := [v for v, x in left.items() if len(x) < k]:
            for v in gone:
                core[v] = k - 1
            left = {v: x - set(gone) for v, x in left.items() if v not in gone}
    assert dict(rows(graph.core_numbers(edges_of(spark, edges), spark.range(33)))) == core and len(set(core.values())) > 3
    assert rows(graph.core_numbers(edges_of(spark, edges).limit(0))) == []
