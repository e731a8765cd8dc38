import numpy as np
import pytest
from helpers import rows

from millrace.llm.neardup import Cells, near_duplicates


def brute(data, threshold=0.98):
    ids = sorted({i for i, *_ in data})
    vec = {i: (np.array(v, float), l) for i, v, l in data}
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            (x, l), (y, m) = vec[a], vec[b]
            if a != b and l is not None and l == m and len(x) == len(y) and x.any() and y.any() and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                near[a].add(b)
    out = set()
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out.add((i, len(near[i]), min(seen), min(seen) == i))
    return out


def vectors(seed, n, hot):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        v = r.standard_normal(24)
        out.append(v)
        out += [v + r.standard_normal(24) * 0.1 * r.random() for _ in range(r.choice([0, 0, 1, 3]))]
    base = r.standard_normal(24)
    out += [base + r.standard_normal(24) * 0.12 for _ in range(hot)] + [base] * 5
    return [(i, [float(np.float32(x)) for x in v], [1, 2, None][k % 3] if i < 2 * n else 1) for i, (k, v) in enumerate((r.integers(0, 9), v) for v in out)]


@pytest.mark.parametrize("block", [512, 48])
def test_against_brute_force(spark, block):
    data = vectors(3, 150, 80)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = near_duplicates(df, leaf=32, block=block)
    assert {tuple(r) for r in got.collect()} == brute(data)


def test_odd_rows(spark):
    one = [0.5, 0.25]
    data = [(1, one, 1, "x"), (2, one, 1, "x"), (2, one, 1, "x"), (3, one, 2, "x"), (4, one, None, "x"), (5, None, 1, "x"), (6, [0.0, 0.0], 1, "x"), (7, [None, 1.0], 1, "x"), (8, [float("nan"), 1.0], 1, "x"), (9, [0.5, 0.25, 0.0], 1, "x"), (None, one, 1, "x"), (10, [], 1, None), (11, [-0.5, -0.25], 1, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, component_id string")
    got = rows(near_duplicates(df))
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), *[(i, 0, i, True) for i in range(3, 12)], (None, 0, None, False)], key=repr)
    assert rows(near_duplicates(df.limit(0))) == []


def test_dense_clusters_side_by_side(spark):
    """Each vector has more nearer neighbours in its own cluster than a list of nearest ones would hold."""
    r = np.random.default_rng(8)
    a, b = np.linalg.qr(r.standard_normal((64, 2)))[0].T
    other = 0.985 * a + np.sqrt(1 - 0.985**2) * b
    data = [(i, [float(x) for x in c + r.standard_normal(64) * 1e-5], 1) for i, c in enumerate([a] * 200 + [other] * 200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = near_duplicates(df).collect()
    assert {r.component_id for r in got} == {0} and sum(r.n_links for r in got) == 400 * 399


def test_few_links_among_many_vectors(spark):
    """So few vectors have a link that a sample of them sees none."""
    r = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    x = unit(r.standard_normal((6000, 64)))
    d = r.standard_normal((8, 64))
    d = unit(d - (d * x[:8]).sum(axis=1)[:, None] * x[:8])
    x = np.concatenate([x, 0.981 * x[:8] + np.sqrt(1 - 0.981**2) * d])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, leaf=4).collect()}
    assert got == {i: (1, i % 6000) if i < 8 or i >= 6000 else (0, i) for i in range(6008)}


def test_any_magnitude(spark):
    """Cosines of vectors whose squares overflow or vanish."""
    data = [(1, [1e-200, 0.0], 1), (2, [1.0, 1.0], 1), (3, [1e200, 1e200], 1), (4, [2e200, 2e200], 1), (5, [5e-324, 0.0], 1), (6, [1.7e308, -1.7e308], 1)]
    got = rows(near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")))
    assert got == [(1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False), (4, 2, 2, False), (5, 1, 1, False), (6, 0, 6, True)]


@pytest.mark.parametrize("cell", [2048, 40])
def test_the_check_finds_what_the_descent_leaves(spark, cell):
    """With one round and short lists, the result is the same, and the audit says what was missing."""
    data, report = vectors(5, 250, 90), {}
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = near_duplicates(df, k=2, trees=1, leaf=8, widest=2, rounds=1, cell=cell, report=report)
    assert {tuple(r) for r in got.collect()} == brute(data)
    assert report["nodes"] > 400 and report["links"] > 0 and 0 < report["recall"] < 1


def test_cells_reach_every_point_nearby():
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 20)) * np.linspace(2, 0.1, 20)
    tree, radius = Cells(x[:500]), r.random(3000) * 1.5
    for levels in (0, 3, 7):
        row, cell, own = tree.reached(x, radius, np.full(3000, levels))
        home = np.zeros(3000, np.int64)
        home[row[own]] = cell[own]
        assert sorted(row[own].tolist()) == list(range(3000)) and len(set(home.tolist())) > levels
        seen = set(zip(row.tolist(), cell.tolist(), strict=True))
        far = np.sqrt(((x[:200, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        assert all((i, home[j]) in seen for i, j in zip(*np.nonzero(far <= radius[:200, None]), strict=True))
        assert levels < 3 or len(seen) < 3000 * 2**levels * 0.8


def test_ids_are_whole_numbers(spark):
    df = spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<double>, label int")
    with pytest.raises(ValueError, match="whole numbers"):
        near_duplicates(df)
