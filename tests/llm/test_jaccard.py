import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import rows

from millrace.llm import groups, jaccard
from millrace.llm.words import Table, word_hashes


def brute(docs, threshold=0.8, words=5):
    """{id: (class, links)} for distinct ids with one text each."""
    sets = {}
    for i, t in docs:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids, near = sorted(sets), defaultdict(set)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                near[a].add(b)
                near[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[i] = (min(seen), len(near[i]))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    shared = [word() for _ in range(12)]
    docs = []
    for _ in range(n):
        base = [word() for _ in range(r.randint(1, 120))]
        docs.append(base)
        for _ in range(r.choice([0, 0, 1, 4])):
            new = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                new[r.randrange(len(new))] = word()
            docs.append(new + (shared if r.random() < 0.3 else []))
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_against_brute_force(spark):
    docs = corpus(1, 120)
    got = jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == brute(docs)


def test_large_buckets_and_blocks(spark):
    """A group of near copies that no bucket holds whole, split twice and compared in blocks."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    docs = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(r.randrange(150) for _ in range(150))] + [(1000 + i, t) for i, t in corpus(2, 30)]
    got = jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), small=20, block=30)
    assert {x.doc_id: (x.class_id, x.n_links) for x in got.collect()} == brute(docs)


def test_blocks_of_exact_comparison(spark):
    members = spark.createDataFrame([(7, i, 1 + i % 2, 10, float(i // 10)) for i in range(40)] + [(8, 100, 1, 10, 1.0)], "grp long, node long, w long, size long, x double")
    same = lambda a, b, _: np.array(a[0])[:, None] == np.array(b[0])[None, :]
    from millrace.llm.common import Scratch

    for per_block in (5, 100):
        work = Scratch(spark, "t")
        got = {r.node: (r.links, r.root) for r in groups.links_and_components(members, same, ["x"], work, per_block).collect()}
        assert got == {i: (15 - (1 + i % 2), i // 10 * 10) for i in range(40)}
        work.drop()
    inner, joined = groups.inner_roots(np.array([5, 3, 9, 8]), np.array([[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool), 2)
    assert inner.tolist() == [3, 9, 8] and joined.tolist() == [[False, True, False], [True, False, False], [False, False, False]]


def test_odd_rows(spark, odd_docs):
    got = jaccard.jaccard_join(odd_docs.withColumnRenamed("lang", "node").withColumnRenamed("source", "grp"))
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.class_id, r.n_links))
    assert by[1] == [(1, 1)] and len(by[2]) == 3 and by[2].count((1, 1)) == 2
    assert by[3] == by[4] == [(3, 1)] and by[8] == by[9] == [(8, 1)] and by[10] == by[11] == [(10, 1)]
    assert by[5] == [(5, 0)] and by[6] == [(6, 0)] and by[7] == [(7, 0)] and by[None] == [(None, 0)] * 2
    assert rows(jaccard.jaccard_join(odd_docs.limit(0))) == []


def test_overlaps_and_hashes():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 50, r.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert jaccard.overlaps(sets, sets).tolist() == want
    assert jaccard.overlaps(sets[:4], sets[4:]).tolist() == [row[4:] for row in want[:4]]
    assert jaccard.overlaps(sets[:1], sets[1:2]).tolist() == [[want[0][1]]]
    raw = b"  ab  cd\nab\tcd\x85 " + b"z" * 3_000_000 + b" ab"
    h = word_hashes(raw)
    assert len(h) == len(raw.split()) == 6 and h[0] == h[2] == h[-1] and len(set(h.tolist())) == 4
    made = []
    t = Table(lambda k: made.append(k) or k.upper(), 2, wide=3)
    assert [t[x] for x in "a b c a d wide wide".split()] == ["A", "B", "C", "A", "D", "WIDE", "WIDE"] and made == ["a", "b", "c", "d", "wide", "wide"]


def test_words_that_polynomials_confuse(spark):
    """Words of 4096 letters that a polynomial modulo 2^64 can't tell apart, whatever its factor."""
    x = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    y = x.translate(str.maketrans("ab", "ba"))
    assert len(set(word_hashes(f"{x} {y}".encode()).tolist())) == 2
    df = spark.createDataFrame([(1, x), (2, y), (3, f"{x} z z z z"), (4, f"{y} z z z z")], "doc_id long, text string")
    assert rows(jaccard.jaccard_join(df)) == [(k, k, 0) for k in range(1, 5)]


def test_ids_are_whole_numbers(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        jaccard.jaccard_join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("depth", [1, 5])
def test_any_depth(spark, depth):
    """Boilerplate that all share, and groups of near copies: the same result however deep buckets are split."""
    r = random.Random(9)
    shared = [f"s{k}" for k in range(40)]
    docs = []
    for k in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        docs += [(10 * k + i, " ".join(shared + base[: 60 - i])) for i in range(r.choice([1, 1, 3]))]
    got = jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), small=8, max_depth=depth)
    assert {x.doc_id: (x.class_id, x.n_links) for x in got.collect()} == brute(docs)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 2000])
def test_paths_expect_one_shared_token(n):
    r = np.random.default_rng(n)
    h = np.sort(r.integers(0, 2**63, n).astype(np.uint64))
    kids = jaccard.chosen(h, np.arange(1, 2001, dtype=np.uint64), 0.8)
    assert 0.9 * min(n, 1.25) < len(kids) / 2000 < 1.1 * min(n, 1.25) + 0.01


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " x"), (3, a + " y"), (4, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(df).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 1, 2)]


def test_texts_that_are_asked_for(spark):
    """The filter before the shuffle of texts loses none that is asked for, and leaves most others out."""
    texts = spark.range(4000).selectExpr("id AS doc", "xxhash64(cast(id AS string)) AS th", "cast(id AS string) AS text")
    for n in (0, 1, 200):
        got = {r.doc for r in jaccard.asked_for(texts, texts.where(f"doc < {n}"), 4000).collect()}
        assert set(range(n)) <= got and len(got) <= 1.2 * n


def test_near_copies_are_compared_once(spark, monkeypatch):
    """A group of near copies fills many large buckets; those whose members are joined already aren't compared."""
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    docs = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(r.randrange(150) for _ in range(150))] + [(1000 + i, t) for i, t in corpus(2, 10)]
    seen, real = [], jaccard.compare_groups

    def counted(members, *args, **kwargs):
        seen.append(members.groupBy("grp").count().where("count > 30").count())
        return real(members, *args, **kwargs)

    monkeypatch.setattr(jaccard, "compare_groups", counted)
    got = jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), small=20, block=30)
    assert {x.doc_id: (x.class_id, x.n_links) for x in got.collect()} == brute(docs)
    assert 1 <= sum(seen) <= 12, seen


def test_workers_drop_other_operators_models():
    """A model that an earlier operator left in a worker goes before texts are cut into shingles."""
    from millrace.llm import common

    common.once("a model", lambda: 1)
    common.forget()
    assert not common._held
