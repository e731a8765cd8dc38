import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import rows

from millrace.llm import lm
from millrace.llm.common import Scratch


def brute_tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def brute_base(docs, held):
    c = Counter(w for i, t in docs if not held(i) for w in brute_tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(brute_tokens(t)), sum(c[w] > 0 for w in brute_tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in brute_tokens(t))) for i, t in docs}


def test_base_and_counts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = brute_base(docs, held)
    got = lm.op5_lm_scoring(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, held(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    # The model does better than the base on texts that it didn't see.
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.93 * sum(r.base_score for r in out)
    again = {r.doc_id: r.score for r in lm.op5_lm_scoring(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_probabilities_sum_to_one(spark):
    texts = [(f"the {w} of the sea and {w} again {w}",) for w in "aa bb cc dd aa aa bb".split()] * 3
    df = spark.createDataFrame(texts, "text string")
    model, samples, _ = lm.train(df, Scratch(spark, "t"), sweeps=4, keep=2)
    pieces = model.collect()
    assert len(samples) == 2
    for k, s in enumerate(samples):
        for cls in (0, ord("e") << 8 | ord("h"), ord("a") << 8 | ord("a"), 12345):
            total = 0.0
            for row in pieces:
                p = lm.Piece.of(row.asDict(), row["kept"][k])
                total += p.predict(p.words, np.full(len(p.words), cls), s).sum()
            assert math.isclose(total + lm._absent([s], np.array([cls]))[0], 1.0, rel_tol=1e-9)




def test_seating_is_consistent(spark):
    df = spark.createDataFrame([("a b a c " * 40,), ("b b a",), ("",), (None,)], "text string")
    model, samples, _ = lm.train(df, Scratch(spark, "t"), sweeps=3, keep=1)
    for row in model.collect():
        p = lm.Piece.of(row.asDict())
        t2, t1, t0 = p.seats
        c1, c0 = p.customers()
        assert (t2 >= 1).all() and (t2 <= p.counts).all() and (t1 >= 1).all() and (t1 <= c1).all() and (t0 >= 1).all() and (t0 <= c0).all()
    s = samples[0]
    assert s["N"] == 163 + 4 and s["V"] == 4 and s["C0"] == s["T1"].sum() and s["C1"].sum() == s["T2"].sum()


def test_reseat_has_the_expected_tables():
    """The mean number of tables in a restaurant of one dish is known in closed form."""
    rng, c, theta, d = np.random.default_rng(1), 60, 2.0, 0.5
    got = lm.reseat(np.full(20_000, c), np.full(20_000, theta), 0.0, rng).mean()
    assert abs(got - sum(theta / (theta + i) for i in range(c))) < 0.1
    few = lm.reseat(np.array([0, 1, 2, 10**9]), np.full(4, 1e-9), d, rng)
    assert few.tolist()[:3] == [0, 1, 1] and few[3] >= 1
    slow = lm.reseat(np.full(3000, 5000), np.full(3000, theta), 0.0, rng).mean()
    assert abs(slow - sum(theta / (theta + i) for i in range(5000))) < 0.5


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "n_known")
    got = lm.score_texts(docs, docs.where("doc_id > 2"), sweeps=2, keep=1)
    assert got.columns == ["doc_id", "n_chars", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    by = {(r.doc_id, r.n_tokens): r for r in got.collect()}
    assert got.count() == odd_docs.count() and by[7, 1].n_known == 1 and by[None, 1].n_tokens == 1
    assert rows(lm.score_texts(docs.limit(0), docs, sweeps=1, keep=1)) == []
    none = lm.score_texts(docs.where("doc_id < 6"), docs.limit(0), sweeps=1, keep=1).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)} and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in none)


def test_scores_by_brute_force(spark):
    """The score, from the same seats, restaurant by restaurant, summed up here anew."""
    texts = ["the sea of the sea", "the SEA and a hill", "a hill of the sea the sea", "", "and the hill of a sea"] * 4
    df = spark.createDataFrame(list(enumerate([*texts, "the hill of nowhere the sea", "sea"])), "doc_id long, text string")
    train = df.where("doc_id < 20")
    model, samples, _ = lm.train(train.select("text"), Scratch(spark, "t"), sweeps=5, keep=2, seed=3)
    tables = []
    for k in range(2):
        seats = {}  # (level, restaurant, word) -> customers, tables
        for row in model.collect():
            piece = lm.Piece.of(row.asDict(), row["kept"][k])
            t2, t1, t0 = piece.seats
            for i, (w, c) in enumerate(zip(piece.word, piece.classes, strict=True)):
                seats[2, int(c), int(piece.words[w])] = (int(piece.counts[i]), int(t2[i]))
                at = (1, int(c) >> lm.BITS, int(piece.words[w]))
                seats[at] = (seats.get(at, (0, 0))[0] + int(t2[i]), 0)
            for w, u, t in zip(piece.word1, piece.upper, t1, strict=True):
                seats[1, int(u), int(piece.words[w])] = (seats[1, int(u), int(piece.words[w])][0], int(t))
                at = (0, 0, int(piece.words[w]))
                seats[at] = (seats.get(at, (0, 0))[0] + int(t), int(t0[w]))
        tables.append(seats)
    words = {w for s in tables for level, _, w in s if level == 0}

    def prob(seats, d, level, room, word):
        if level < 0:
            return 1 / (len(words) + 1)
        here = [v for (lv, r, _), v in seats.items() if (lv, r) == (level, room)]
        c, t = seats.get((level, room, word), (0, 0))
        up = {2: (1, room >> lm.BITS), 1: (0, 0), 0: (-1, 0)}[level]
        theta = lm.THETA[level]
        return (c - d[level] * t + (theta + d[level] * sum(x for _, x in here)) * prob(seats, d, *up, word)) / (theta + sum(x for x, _ in here))

    got = {r.doc_id: r.score for r in lm.score_texts(df, train, sweeps=5, keep=2, seed=3).collect()}
    for i, text in [*enumerate(texts[:5]), (20, "the hill of nowhere the sea"), (21, "sea")]:
        total, room = 0.0, 0
        for w in [*text.lower().encode().split(), None]:
            h = int(lm.END) if w is None else int(np.frombuffer(lm._token(w), lm.TOKEN)["hash"][0])
            total += math.log10(sum(prob(s, x["d"], 2, room, h) for s, x in zip(tables, samples, strict=True)) / 2)
            room = 0 if w is None else int(np.frombuffer(lm._token(w), lm.TOKEN)["context"][0])
        assert math.isclose(got[i], total, rel_tol=1e-12), (i, got[i], total)


def test_reseat_draws_from_the_conditional():
    """The tables of a dish of four customers, whose every seating is listed."""
    rng, d, weight, gain = np.random.default_rng(4), 0.4, 0.7, 0.3
    chance = Counter()

    def sit(sizes, left, p):
        if not left:
            chance[len(sizes)] += p
            return
        for k, n in enumerate(sizes):
            sit([*sizes[:k], n + 1, *sizes[k + 1 :]], left - 1, p * (n - d))
        sit([*sizes, 1], left - 1, p * (weight + gain * len(sizes)))

    sit([], 4, 1.0)
    got = Counter(lm.reseat(np.full(40_000, 4), np.full(40_000, weight), d, rng, gain).tolist())
    assert all(abs(got[t] / 40_000 - chance[t] / sum(chance.values())) < 0.01 for t in range(1, 5))


def test_word_order_counts(spark):
    """Texts of the same words in another order are told apart, and texts that occur twice from those that occur once."""
    r = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(r.choice(vocabulary, 60)) for _ in range(150)]
    other = [" ".join(r.permutation(t.split())) for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(texts[:50])] + [(2000 + k, t) for k, t in enumerate(other)], "doc_id long, text string")
    got = {x.doc_id: x.score - x.base_score for x in lm.score_texts(df, df.where("doc_id < 2000"), sweeps=3, keep=2).collect()}
    once, twice, shuffled = ([got[k] for k in ids] for ids in (range(50, 150), range(50), range(2000, 2150)))
    assert np.mean(once) > np.mean(shuffled) + 5 and np.mean([a > b for a in twice for b in once]) > 0.9


def test_words_that_polynomials_confuse(spark):
    x = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    y = x.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm.score_texts(df, df.where("doc_id = 1"), sweeps=1, keep=1).collect()} == {1: 2, 2: 1}


def test_packing():
    for v in ([], [0], [254, 255, 256, 3, 2**40], [300] * 5):
        assert lm.wide(lm.narrow(np.array(v, np.int64))).tolist() == v
    p = np.array([1.0, 0.5, 1e-9, 1e-60])
    assert np.allclose(lm.unpacked_logs(lm.packed_logs(p)), np.log10(p), rtol=0, atol=1e-12)


def test_each_word_has_its_own_restaurant(spark):
    """As many restaurants as words, however many; texts without a word in common share none."""
    words = [f"w{k}" for k in range(70_000)]
    known = lm._known([w.encode() for w in words])
    assert len(set(known["context"].tolist())) == len(words) == len(set(known["hash"].tolist()))
    assert (lm.word_of(known["context"]) == known["hash"]).all() and {int(c) >> lm.BITS for c in known["context"]} == set(b"0123456789")
    r = np.random.default_rng(2)
    order = r.permutation(words)
    df = spark.createDataFrame([(k, " ".join(order[100 * k : 100 * k + 100])) for k in range(700)], "doc_id long, text string")
    work = Scratch(spark, "t")
    model, samples, _ = lm.train(df.select("text"), work, sweeps=2, keep=1)
    pairs = [(int(c), int(n)) for row in model.collect() for p in [lm.Piece.of(row.asDict())] for c, n in zip(p.classes, p.counts, strict=True)]
    assert len(pairs) == 700 * 101 and len({c for c, _ in pairs}) == 70_001
    assert samples[0]["C2"][known["context"]].tolist() == [1.0] * 70_000 and samples[0]["T2"][known["context"]].tolist() == [1.0] * 70_000
