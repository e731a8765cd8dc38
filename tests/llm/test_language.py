import math
import random

import numpy as np
from helpers import rows

from millrace.llm import language as L
from millrace.llm.pieces import default_model


def brute(word, ids, probs):
    word = "".join(c for c in word if c in ids)
    a = [np.ones(probs.shape[1])] + [np.zeros(probs.shape[1]) for _ in word]
    for e in range(1, len(word) + 1):
        for s in range(e):
            if word[s:e] in ids:
                a[e] = a[e] + a[s] * probs[ids[word[s:e]]]
    return np.log(a[-1])


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "c", "ab", "abc", "bc", "▁a", "▁ab", "é", "cab"]
    ids, r = {p: i for i, p in enumerate(pieces)}, random.Random(1)
    probs = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 3).T
    seg = L.Segmenter(pieces)
    words = ["▁" + "".join(r.choice("abcéx日") for _ in range(r.randint(0, 12))) for _ in range(200)] + ["▁" + "abc" * 15]
    for w, got in zip(words, seg.forward(words, probs), strict=True):
        assert np.allclose(got, brute(w, ids, probs)), w
    long = "▁" + "abcé" * 40
    assert np.allclose(seg.running(long, probs), brute(long, ids, probs))
    assert np.isfinite(seg.running("▁" + "ab" * 20_000, probs)).all()


def test_unknown_characters_stand_as_bytes():
    pieces = ["▁", "a", "b", "ab", *map(L.byte_piece, range(256))]
    ids = {p: i for i, p in enumerate(pieces)}
    probs = np.random.default_rng(2).dirichlet(np.ones(len(pieces)), 3).T
    for w in ["▁ab", "▁日b", "▁😀é", "▁" + "ab" * 18 + "日" * 6]:
        spelt = "".join(c if c in ids else "".join(map(L.byte_piece, c.encode())) for c in w)
        assert np.allclose(L.Segmenter(pieces).forward([w], probs)[0], brute(spelt, ids, probs))


def test_posterior_by_brute_force(spark):
    """The score is the posterior that all segmentations of all words give, under equal priors."""
    docs = spark.createDataFrame([(1, "la ta ra", "p"), (2, "ke ki ke", "q"), (3, "la ke ½ 日", None), (4, "ta KI", None)], "doc_id long, text string, lang string")
    model = L.fit_languages(docs, default_model(), rounds=2)
    pieces = L.vocabulary_of(default_model())
    ids = {p: i for i, p in enumerate(pieces)}
    for r in L.identify(docs, model).collect():
        total = 0
        for w in r.text.lower().split():
            total = total + brute("".join(c if c in ids else "".join(map(L.byte_piece, c.encode())) for c in "▁" + w), ids, model[1])
        best = int(total.argmax())
        assert r.lang_pred == model[0][best] and math.isclose(r.score, 1 / np.exp(total - total[best]).sum(), rel_tol=1e-9)


def test_letters_are_category_l(spark):
    model = L.fit_languages(spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string"), default_model())
    texts = ["½ ²③", "Ⅷ ٣", "\u0301 \u20dd", "½ a", "ª", "日", "_", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.lang_pred for r in L.identify(df, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en", "en", "en", "und", "und"]


def test_em_raises_the_likelihood():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab"]
    words, counts = ["▁ab", "▁abab", "▁b"], [10, 5, 2]
    seg, last = L.Segmenter(pieces), -math.inf
    for rounds in range(1, 5):
        p = seg.fit(words, counts, len(pieces), rounds, 1e-9)
        assert math.isclose(p.sum(), 1.0)
        now = (seg.forward(words, p[:, None])[:, 0] * counts).sum()
        assert now >= last - 1e-9
        last = now


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = L.op7_language_id(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    held = [r for r in got.collect() if r.held_out]
    assert len(held) > 30 and sum(docs[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_predictions_ignore_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    model = L.fit_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs.select("doc_id", "text"), model).collect()}
    assert a == b


def test_odd_rows(spark, odd_docs):
    model = L.fit_languages(odd_docs, default_model())
    assert model[0] == ["en", "fr"]
    clash = odd_docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "lang_pred")
    got = L.identify(clash, model)
    assert got.columns == ["doc_id", "text", "n_chars", "lang_pred", "score"] and got.count() == odd_docs.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert by[5] == by[6] == by[7] == by[12] == ("und", 0.0) and by[8][0] in ("en", "fr")
    assert rows(L.identify(odd_docs.limit(0), model)) == []
    none = L.fit_languages(odd_docs.limit(0), default_model())
    assert {(r.lang_pred, r.score) for r in L.identify(odd_docs, none).collect()} == {("und", 0.0)}


def test_long_words_are_fitted(spark, monkeypatch):
    pieces, r = ["▁", "a", "b", "c", "ab", "abc", "bc", "▁a", "cab"], random.Random(4)
    words = ["▁" + "".join(r.choice("abc") for _ in range(n)) for n in (5, 30, 45, 60, 70)]
    seg = L.Segmenter(pieces)
    split = seg.fit(words, [3, 1, 2, 1, 4], len(pieces), 3, 0.02)
    monkeypatch.setattr(L, "LONG", 100)
    assert np.allclose(split, seg.fit(words, [3, 1, 2, 1, 4], len(pieces), 3, 0.02))
    monkeypatch.setattr(L, "LONG", 40)
    assert np.isfinite(seg.fit(["▁" + "abc" * 5000], [1], len(pieces), 2, 0.02)).all()

    texts = [(k, "".join(r.choice(letters) for _ in range(r.randint(60, 300))), lang) for k, (lang, letters) in enumerate([("p", "abcdefgh"), ("q", "klmnopqr"), ("r", "stuvwxyz")] * 8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = L.identify(docs, L.fit_languages(docs, default_model())).collect()
    assert all(x.lang_pred == x.lang and x.score > 0.9 for x in got) and len(got) == 24
