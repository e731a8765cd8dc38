import itertools
import math
import random

import numpy as np
import pytest
from helpers import rows

from millrace.llm import toxicity
from millrace.llm.toxicity import DEFAULTS, REACH, SCOPE, Grammar


def brute(words, weights):
    """The weight of the best reading of a clause, by the marks' definitions."""
    best = -math.inf
    for path in itertools.product(*words):
        kinds, total = [x for x, _ in path], sum(w for _, w in path)
        said, quoted, out = False, False, []
        for k, x in enumerate(kinds):
            if x == "say":
                said = True
            elif x == "quote":
                said = not said
            elif x in ("insult", "threat"):
                x += "/n" * ("not" in kinds[max(0, k - SCOPE) : k]) + "/r" * said
                x += "/t" * ("target" in kinds[max(0, k - REACH) : k + REACH + 1])
                total += weights[x]
                out.append(x)
        best = max(best, total)
    return best


def test_composed_machine_against_brute_force():
    r = random.Random(1)
    weights = {k: round(r.uniform(-4, 4), 3) for k in DEFAULTS}
    machine = Grammar({}, weights).machine
    for _ in range(600):
        words = []
        for _ in range(r.randint(0, 9)):
            kind = r.choice(["word", "word", "target", "not", "say", "quote", "insult", "threat"])
            words.append([("word", 0.0), (kind, r.uniform(0, 5))] if kind in ("insult", "threat") else [(kind, 0.0)])
        got, path = machine.best(words)
        assert abs(got - brute(words, weights)) < 1e-9
        assert abs(got - sum(weights.get(x, 0.0) for x in path) - sum(dict(ws).get(x.partition("/")[0], 0.0) for ws, x in zip(words, path, strict=True))) < 1e-9


def test_composition_is_one_transducer_after_the_other():
    r = random.Random(2)
    parts = [toxicity.reported_speech(), toxicity.negation(), toxicity.targets()]
    whole = parts[0] @ parts[1] @ parts[2]
    for _ in range(200):
        symbols = [r.choice(["word", "target", "not", "say", "quote", "insult", "threat"]) for _ in range(r.randint(0, 12))]
        step = symbols
        for p in parts:
            step = p.best([[(x, 0.0)] for x in step])[1]
        assert whole.best([[(x, 0.0)] for x in symbols])[1] == step


def test_marks():
    g = Grammar({"fool": 3.0}, DEFAULTS)
    found = lambda t: [(t[a:b].strip(), round(w, 6), e) for a, b, w, e in g.clauses(t)]
    assert found("You fool! A fool. nothing") == [("You fool", 4.0, ["insult/t"]), ("A fool", 3.0, ["insult"])]
    assert found("you are not a fool") == [("you are not a fool", 1.5, ["insult/n/t"])]
    assert found("he said fool fools; they kill you") == [("he said fool fools", 3.0, ["insult/r/t", "insult/r/t"]), ("they kill you", 2.0, ["threat/t"])]
    assert found("they do not kill") == [] and found("a kill") == [] and found("") == []
    assert found("İ\nthe FOOLISH one") == [("the FOOLISH one", 3.0, ["insult"])]


def test_letters_add_up():
    """An entry's weight is what its longest known beginning has; a blank ends whole words."""
    entries = {"lump": 2.0, "lumpy ": 5.0, "lumpex": -1.0, "clod ": 4.0}
    g = Grammar(entries, DEFAULTS)
    want = {"lump": 2.0, "lumps": 2.0, "lumpy": 5.0, "lumpyx": 2.0, "lumpexx": -1.0, "clod": 4.0, "clods": 0.0, "lum": 0.0, "": 0.0}
    assert {w: round(g.insult(w), 9) for w in want} == want


def test_lexicon():
    got = toxicity.lexicon_of([("lowe", 100, 0), ("lowea ", 50, 0), ("lowex ", 1, 60), ("rare ", 3, 0), ("then", 40, 400)], 0.1)
    assert set(got) == {"lowe", "lowea ", "lowex "} and got["lowea "] > got["lowe"] > 4 and got["lowex "] < toxicity.LEAST


def test_rates_stay_below_one():
    """Beginnings of beginnings, each of which only toxic clauses have."""
    got = toxicity.lexicon_of([("scoundrel"[:k], 10**6, 0) for k in range(4, 10)], 0.05)
    assert got["scou"] > 5 and all(math.isfinite(w) for w in got.values())


def test_weights_of_events():
    """Without counts, those of DEFAULTS; with counts, what they say against plain insults."""
    none = toxicity.event_weights({}, 0.1)
    assert all(abs(none[e] - w) < 1e-6 for e, w in DEFAULTS.items() if e != "insult") and none["insult"] == 0.0
    seen = {("insult", 1): 900, ("insult", 0): 100, ("insult/n", 1): 10, ("insult/n", 0): 390, ("insult/r", 1): 900, ("insult/r", 0): 100, ("threat/t", 0): 500}
    got = toxicity.event_weights(seen, 0.1)
    assert got["insult"] == 0.0 and got["insult/n"] < -4 and abs(got["insult/r"]) < 0.3 and got["threat/t"] < 0.0


def made(n, seed, toxic=0.2):
    """Clean prose, toxic prose with insults of a lexicon unknown to the library, and copies of one toxic text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "ri", "no", "be", "lo", "un"]) for _ in range(r.randint(1, 4)))
    out = []
    for k in range(n):
        bad = r.random() < toxic
        words = [word() for _ in range(r.randint(5, 60))]
        for _ in range(r.randint(1, 3) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["grubl", "grublish", "Zwockel", "vratt" + word(), "vratt" + word()]))
        for _ in range(len(words) // 8):
            words.insert(r.randrange(len(words)), r.choice([".", "not", "you", "said"]))
        out.append((k, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows_ = made(1200, 3) + [(2000 + k, "one passage of toxic text again and again. uniqueword grubl", 1) for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows_], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows_ if i % 4 != 2], "doc_id long, toxic int")
    return rows_, docs, toxicity.fit_toxicity(docs, labels)


def test_held_out_texts(spark, fitted):
    rows_, docs, model = fitted
    y = {i: v for i, _, v in rows_}
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.score_toxicity(docs, model).collect() if r.doc_id % 4 == 2]
    right = [p == y[i] for i, _, p in got]
    assert np.mean(right) > 0.98 and all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p in got)
    words = {e.strip() for e, w in model["lexicon"].items() if w > 0}
    assert any("grubl".startswith(w) for w in words) and any("vratt".startswith(w) for w in words)
    assert not words & {"uniqueword", "passage", "toxic", "again"}  # copies of a text count once


def test_reruns_agree(spark, fitted):
    _, docs, model = fitted
    assert rows(toxicity.score_toxicity(docs.repartition(7), model)) == rows(toxicity.score_toxicity(docs, model))


def test_odd_rows(spark, odd_docs, fitted):
    model = fitted[2]
    clash = odd_docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "c0").selectExpr("*", "1 AS `a.b`")
    got = toxicity.score_toxicity(clash, model)
    assert got.columns == ["doc_id", "text", "c0", "n_chars", "a.b", "score", "predicted", "clauses"]
    assert got.count() == odd_docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score_toxicity(odd_docs.limit(0), model).count() == 0
    empty = {r.score for r in got.where("text IS NULL OR text = ''").collect()}
    assert len(empty) == 1
    long = spark.createDataFrame([(1, "ri no " * 60_000 + ". you grubl")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score_toxicity(long, model).collect()] == [1]


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (3, "d e")], "doc_id long, text string")
    none = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    one = toxicity.fit_toxicity(docs, spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int"))
    odd = toxicity.fit_toxicity(docs, spark.createDataFrame([(1, 0), (1, 1), (3, 0), (9, 1)], "doc_id long, toxic int"))
    assert none["lexicon"] == one["lexicon"] == odd["lexicon"] == {}
    for m in (none, one, odd):
        assert all(0 < r.score < 1 for r in toxicity.score_toxicity(docs, m).collect())
    gone = toxicity.fit_toxicity(docs.limit(0), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    assert gone["lexicon"] == {}


def test_query(spark, sf_dir):
    got = toxicity.op11_toxicity(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    back = got.collect()
    assert len(back) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert np.mean([r.predicted == y[r.doc_id] for r in back if r.doc_id in y]) > 0.9
