import math
from collections import defaultdict

from helpers import rows

from millrace.llm.mixing import mix_sources, op3_mix_sources


def targets(sizes, weights=(5, 2, 1), most=3):
    """By resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def check(got, docs):
    size = lambda t: len((t or "").encode().split())
    totals = defaultdict(int)
    for _, t, s in docs:
        totals[s] += size(t)
    want, taken, largest = targets(dict(totals)), defaultdict(int), defaultdict(int)
    assert len(got) == len(docs)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == totals[r.source]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1.01 * largest[s] + 1e-6


def test_mix(spark):
    docs = [(i, "w " * (1 + i * i % 97), None if i % 11 == 0 else "abcdefg"[i % 7 if i % 3 else 0]) for i in range(400)]
    docs += [(1000, None, "none"), (1001, "", "none"), (1002, "x" * 5000, "b")] + [(2000, "dup dup", "c")] * 30 + [(None, "a b", "d"), (None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix_sources(df).collect()
    check(got, docs)
    again = mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert max(r.copies for r in got) == 3


def test_one_source_and_empty(spark):
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(9)], "doc_id long, text string, source string")
    assert {(r.copies, r.target) for r in mix_sources(df).collect()} == {(1, 27.0)}
    assert rows(mix_sources(df.limit(0))) == []
    none = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mix_sources(none).collect()} == {(0, 0.0)}


def test_odd_rows(spark, odd_docs):
    got = mix_sources(odd_docs.withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")).collect()
    check(got, [(r.doc_id, r.text, r.source) for r in odd_docs.collect()])


def test_query(spark, sf_dir):
    got = op3_mix_sources(spark, sf_dir)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and got.count() == 200
