import math

import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from millrace.llm.topk import build_tree, quantised, search_tree, top_k


def brute(vectors, queries, k):
    out = []
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    data = [(int(i), [int(x) for x in r.integers(-5, 6, 4)]) for i in range(900)] + [(1000 + i, [1, 0, 0, 0]) for i in range(40)] + [(2000, [3, 4]), (2001, [1, 1])]
    df = spark.createDataFrame(data, "vec_id long, vec array<long>")
    asked = [(i, v) for i, v in data if i % 9 == 0 or i >= 1990]
    want = brute(data, asked, 5)
    for shard_rows, block_rows in ((10_000, 10_000), (150, 20)):
        got = top_k(df, df.where("vec_id % 9 = 0 OR vec_id >= 1990"), 5, shard_rows, block_rows)
        assert sorted(map(tuple, got.collect())) == want


def test_large_numbers_stay_exact():
    ids, points = np.array([1, 2, 3]), np.array([[2**40, 1], [2**40, 2], [0, 0]])
    tree = build_tree(ids, points)
    got = sorted(search_tree(tree, np.array([9]), np.array([[2**40, 1]]), [None], 2), key=lambda x: -x[1])
    assert [(s, i) for _, s, i in got] == [(2**80 + 2, 2), (2**80 + 1, 1)]


def test_bounds_prune_without_loss():
    r = np.random.default_rng(2)
    points = r.integers(-100, 101, (2000, 3))
    tree = build_tree(np.arange(2000), points)
    q = r.integers(-100, 101, (20, 3))
    for n, (own, scores) in enumerate(zip(range(20), q @ points.T, strict=True)):
        order = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != own)[:5]
        for floor in (None, -order[-1][0]):
            got = sorted((-s, i) for _, s, i in search_tree(tree, np.array([own]), q[n : n + 1], [floor], 5))
            assert got == order


def test_odd_rows(spark):
    data = [(0, [1.0, 0.5], "x"), (50, [float("nan"), 1.0], "x"), (100, None, "x"), (1, [None, 1.0], "x"), (2, [float("inf"), 1.0], "x"), (3, [-0.001, 2.0], None), (None, [1.0, 1.0], "x"), (4, [], "x"), (0, [1.0, 0.5], "x"), (150, [0.25, 0.25, 0.25], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    v = quantised(df)
    assert rows(v.where("vec_id = 3")) == [(3, [math.floor(256 * float(np.float32(-0.001))), 512])]
    assert rows(top_k(v, v.where("vec_id % 50 = 0"), 5)) == [(0, 1, 3, 256 * -1 + 128 * 512)]
    assert rows(top_k(v.limit(0), v.limit(0), 5)) == []
    assert rows(top_k(v, v.where(F.lit(False)), 5)) == []
