"""Toxicity by a weighted finite-state grammar of clauses."""

from __future__ import annotations

import math
import re
import uuid
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, column, lean, numbered, once, release, table
from millrace.llm.language import held_out
from millrace.llm.words import Table

#: Words of English, German, French and Spanish that the grammar knows beside what it learns.
TARGETS = "you your you're yourself he him she her they them these those people du dich dir ihr euch er sie ihm ihn tu te toi vous il elle ils elles eux usted ustedes tú ti vosotros él ella ellos ellas".split()
NEGATIONS = "not no never nobody don't doesn't isn't aren't wasn't weren't won't nicht kein keine keinen keiner nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say saying wrote writes called calls quoted claimed claims alleged told tells sagte sagt schrieb nannte behauptete dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = "kill hurt destroy beat burn shoot stab murder attack töten umbringen vernichten verletzen tuer détruire frapper brûler matar destruir golpear quemar herir".split()
QUOTES = '"“”„«»'
#: What a clause's events add before anything is learned, by kind and marks: n negated, r reported, t with a target.
DEFAULTS = {"insult": 0.0, "insult/t": 1.0, "insult/n": -2.0, "insult/n/t": -1.5, "insult/r": -2.0, "insult/r/t": -1.5, "insult/n/r": -3.0, "insult/n/r/t": -3.0} | {"threat": -1.0, "threat/t": 2.0, "threat/n": -2.0, "threat/n/t": -1.0, "threat/r": -2.0, "threat/r/t": -1.0, "threat/n/r": -3.0, "threat/n/r/t": -3.0}
#: Words that a negation reaches, and that a target may be away.
SCOPE, REACH = 3, 4
#: Log-odds from which a word can be read as an insult, and the highest rate of an entry.
LEAST, SURE = 1.0, 0.999
#: Clauses that the prior of a rate counts as, and the least letters of a stem and the most.
PRIOR, STEM, STEMS = 8.0, 4, 10
#: Logistic weights of (1, largest clause score, log of 1 + their sum) where nothing could be learned.
UNTAUGHT = (-3.0, 0.6, 0.3)

CLAUSE = re.compile(r"[^.!?;:\n]+")
TOKEN = re.compile(rf"[^\W\d_]+(?:['’][^\W\d_]+)*|[{QUOTES}]")
PLAIN = ("word", "target", "not", "say", "quote")


class Transducer:
    """A letter-to-letter weighted transducer: arcs[state][symbol] is a list of (symbol out, weight, next state).
    Weights add along a path, the best of several paths counts, and paths end in `final` states (None: in any)."""

    def __init__(self, start, arcs: dict, final: set | None = None):
        self.start, self.arcs, self.final = start, arcs, final

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other one reads."""
        start = self.start, other.start
        arcs, todo = {}, [start]
        while todo:
            p, q = state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for x, own in self.arcs[p].items():
                ways = [(z, v + w, (a, b)) for y, v, a in own for z, w, b in other.arcs[q].get(y, ())]
                if ways:
                    arcs[state][x] = ways
                    todo += [s for *_, s in ways]
        ends = lambda t, s: t.final is None or s in t.final
        return Transducer(start, arcs, {s for s in arcs if ends(self, s[0]) and ends(other, s[1])})

    def best(self, words: list[list[tuple[str, float]]]) -> tuple[float, list[str]]:
        """(weight, symbols written) of the best path over words, each of which may be read as any of its
        (symbol, weight); (-inf, []) if there is none. Of equal paths the one found first counts."""
        at = {self.start: (0.0, None)}
        for readings in words:
            new: dict = {}
            for state, (v, path) in at.items():
                for x, w in readings:
                    for y, u, to in self.arcs[state].get(x, ()):
                        if to not in new or v + w + u > new[to][0]:
                            new[to] = v + w + u, (path, y)
            at = new
        done = [x for s, x in at.items() if self.final is None or s in self.final]
        if not done:
            return -math.inf, []
        weight, path = max(done, key=lambda x: x[0])
        out = []
        while path is not None:
            path, y = path
            out.append(y)
        return weight, out[::-1]


def reported_speech() -> Transducer:
    """Marks what stands after a verb of saying or within quotes as reported (/r)."""
    arcs: dict = {}
    for s, quoted in (("own", "said"), ("said", "own")):
        arcs[s] = {x: [(x, 0.0, s)] for x in PLAIN} | {x: [(x + "/r" * (s == "said"), 0.0, s)] for x in ("insult", "threat")}
        arcs[s] |= {"say": [("say", 0.0, "said")], "quote": [("quote", 0.0, quoted)]}
    return Transducer("own", arcs)


def negation() -> Transducer:
    """Marks events within SCOPE words after a negation (/n)."""
    arcs: dict = {}
    for k in range(SCOPE + 1):
        arcs[k] = {x: [(x, 0.0, SCOPE if x == "not" else max(k - 1, 0))] for x in PLAIN}
        for x in ("insult", "threat"):
            for r in ("", "/r"):
                arcs[k][x + r] = [(x + "/n" * (k > 0) + r, 0.0, max(k - 1, 0))]
    return Transducer(0, arcs)


def targets() -> Transducer:
    """Marks events with a target within REACH words before or after (/t). A state is (seen, not before, by): a
    target counts for `seen` more words; where none does, an event guesses whether one comes: none may come within
    the next words, or one must. Paths whose guess is wrong have no end."""
    marked = [x + m for x in ("insult", "threat") for m in ("", "/n", "/r", "/n/r")]
    arcs: dict = {}
    todo = [(0, 0, 0)]
    while todo:
        if (state := todo.pop()) in arcs:
            continue
        seen, wait, by = state
        arcs[state] = own = {x: [] for x in [*PLAIN, *marked]}
        if not wait:
            own["target"].append(("target", 0.0, (REACH, 0, 0)))
        if by != 1:
            later = max(seen - 1, 0), max(wait - 1, 0), max(by - 1, 0)
            for x in PLAIN:
                if x != "target":
                    own[x].append((x, 0.0, later))
            for x in marked:
                if seen or by:
                    own[x].append((x + "/t", 0.0, later))
                else:
                    own[x] += [(x, 0.0, (0, REACH, 0)), (x + "/t", 0.0, (0, later[1], REACH))]
        todo += [to for ways in own.values() for *_, to in ways]
    return Transducer((0, 0, 0), arcs, {s for s in arcs if not s[2]})


def events(kind: str, weights: dict[str, float]) -> Transducer:
    """The weights of one kind of events, by their marks; other symbols pass."""
    arcs = {x: [(x, 0.0, 0)] for x in [*PLAIN, *weights]}
    arcs |= {x: [(x, w, 0)] for x, w in weights.items() if x.partition("/")[0] == kind}
    return Transducer(0, {0: arcs})


class Grammar:
    """The composed transducers, and the readings of words: a weighted automaton over letters, whose arcs add up to a
    stem's or a word's weight, beside the fixed words."""

    def __init__(self, lexicon: dict[str, float], weights: dict[str, float]):
        self.machine = reported_speech() @ negation() @ targets() @ events("insult", weights) @ events("threat", weights)
        self.letters: dict = {}
        for entry, w in sorted(lexicon.items()):
            at, so_far = self.letters, 0.0
            for c in entry:
                at = at.setdefault(c, {})
                so_far += at.get("", 0.0)
            at[""] = at.get("", 0.0) + w - so_far
        self.fixed = {w: k for k, ws in (("threat", THREATS), ("target", TARGETS), ("not", NEGATIONS), ("say", REPORTS), ("quote", QUOTES)) for w in ws}
        self.readings = Table(self._readings, 1 << 16)

    def insult(self, word: str) -> float:
        """The sum of the weights of the arcs that a word passes, as far as they go; a whole word's entry ends
        in a blank."""
        at, total = self.letters, 0.0
        for c in word + " ":
            at = at.get(c)
            if at is None:
                break
            total += at.get("", 0.0)
        return total

    def _readings(self, word: str) -> list[tuple[str, float]]:
        out = [(self.fixed.get(word, "word"), 0.0)]
        if out[0][0] == "threat":
            out.insert(0, ("word", 0.0))
        if (w := self.insult(word)) >= LEAST:
            out.append(("insult", w))
        return out

    def events(self, word: str) -> bool:
        return self.readings[word][-1][0] in ("insult", "threat")

    def clauses(self, text: str) -> list[tuple[int, int, float, list[str]]]:
        """(start, end, weight, events) of the clauses in which something counts: code points of the text."""
        if not any(map(self.events, set(TOKEN.findall(text.lower())))):
            return []
        out = []
        for m in CLAUSE.finditer(text):
            words = TOKEN.findall(m[0].lower())
            if any(map(self.events, words)):
                weight, path = self.machine.best([self.readings[w] for w in words])
                found = [y for y in path if y.partition("/")[0] in ("insult", "threat")]
                if weight > 0 and found:
                    out.append((m.start(), m.end(), weight, found))
        return out


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def lexicon_of(counts: list[tuple[str, int, int]], rate: float) -> dict[str, float]:
    """Weights of stems and words (entry, toxic clauses, clean clauses): the log-odds of their rate over those of
    the rate of all clauses. A rate is drawn to that of the entry's longest known beginning, as if PRIOR clauses
    had it; entries that say nothing beyond their beginning are left out."""
    rates: dict[str, float] = {}
    out: dict[str, float] = {}
    for entry, pos, neg in sorted(counts):
        below = next((rates[entry[:k]] for k in range(len(entry) - 1, STEM - 1, -1) if entry[:k] in rates), None)
        r = min(SURE, (pos + PRIOR * (rate if below is None else below)) / (pos + neg + PRIOR))
        if r > 0.5 if below is None else abs(logit(r) - logit(below)) > 1.0:
            rates[entry] = r
            out[entry] = logit(r) - logit(rate)
    return out


def event_weights(seen: dict[tuple[str, int], int], rate: float) -> dict[str, float]:
    """What each kind of event adds, from its counts in toxic (1) and clean (0) texts: the log-odds of its rate over
    those of plain insults, which add nothing to what their words weigh, or for threats over those of `rate`; drawn
    to DEFAULTS as if PRIOR events said so."""
    odds = lambda r: logit(min(max(r, 1 - SURE), SURE))
    share = lambda e, r: (seen.get((e, 1), 0) + PRIOR * r) / (seen.get((e, 0), 0) + seen.get((e, 1), 0) + PRIOR)
    out = {}
    for e, w in DEFAULTS.items():
        base = odds(share("insult", 0.5)) if e.startswith("insult") else odds(rate)
        out[e] = 0.0 if e == "insult" else odds(share(e, 1 / (1 + math.exp(-base - w)))) - base
    return out


def _calibrated(x, y, weight):
    """Logistic weights by Newton's method with a small ridge; slopes aren't negative."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    if (beta[1:] < 0).any():
        keep = np.concatenate([[True], beta[1:] >= 0])
        beta = np.zeros(len(keep))
        beta[keep] = _calibrated(x[:, keep], y, weight)
    return beta


def probability(scores: list[float], beta) -> float:
    """The chance of label 1 by the scores of a text's clauses, within 0 and 1."""
    z = beta[0] + beta[1] * max(scores, default=0.0) + beta[2] * math.log1p(sum(scores))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, docs_per_label: int = 20_000, lexicon: int = 20_000, min_clauses: int = 4, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", scratch: Scratch | None = None) -> dict:
    """The grammar's weights from the texts of `docs` that `labels` (id, 0 or 1) speaks of; see score_toxicity.

    The fit takes a bounded sample: about `docs_per_label` whole texts of each label, those whose hash of the id is
    lowest, so that reruns agree; weights make up for the share taken. Stems and words are counted by distinct
    clauses, so that copies of a text count once, and the `lexicon` best supported ones of at least `min_clauses`
    toxic clauses and a rate above one half are kept. What events of each kind and marks add is learned from the
    clauses they are found in, drawn to DEFAULTS, and the scale of the score from the sampled texts; the driver gets
    the lexicon's entries, counts of the sixteen kinds of events and three numbers of each sampled text.

    Rows with a null id, text or label teach nothing; an id that is labelled more than once is toxic if one of its
    labels says so; rows of one id are texts of their own. Without labels of both kinds the lexicon is empty and the
    other weights are DEFAULTS and UNTAUGHT."""
    spark = docs.sparkSession
    lean(spark)
    scratch = scratch or Scratch(spark, "toxicity")
    said = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    said = scratch.write(said, "labels")
    n = {r["y"]: r["n"] for r in said.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"lexicon": {}, "weights": DEFAULTS, "beta": UNTAUGHT}
    shares = {y: min(1.0, docs_per_label / k) for y, k in n.items()}
    limit = lambda y: F.lit(int(-(2**63) + shares[y] * (2**64 - 2**12)))
    picked = said.where(F.xxhash64(F.lit(seed), "id") <= F.when(F.col("y") == 1, limit(1)).otherwise(limit(0)))
    rows = docs.select(column(id_col).alias("_id"), column(text_col).alias("text")).where("text IS NOT NULL")
    # At most about two times docs_per_label ids.
    sample = scratch.write(rows.join(F.broadcast(picked), F.col("_id") == F.col("id")).select("text", "y"), "sample")

    def clauses(batches):
        import pyarrow as pa

        for b in batches:
            found: dict = {}
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                for m in CLAUSE.finditer(text.lower()):
                    if words := TOKEN.findall(m[0]):
                        key = " ".join(words)
                        found[key] = found.get(key, 0) | (2 if y else 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.int32())], names=["clause", "y"])
        release()

    each = sample.mapInArrow(clauses, "clause string, y int").groupBy("clause").agg(F.bit_or("y").alias("y"))
    words = each.select(F.explode(F.array_distinct(F.split("clause", " "))).alias("word"), F.shiftright("y", 1).alias("pos"), F.col("y").bitwiseAND(1).alias("neg"))
    words = words.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    words = scratch.write(words, "words")
    stems = F.transform(F.sequence(F.lit(STEM), F.greatest(F.lit(STEM), F.least(F.length("word"), F.lit(STEMS)))), lambda k: F.substring("word", F.lit(1), k))
    entries = F.array_distinct(F.concat(F.when(F.length("word") >= STEM, stems).otherwise(F.array().cast("array<string>")), F.array(F.concat("word", F.lit(" ")))))
    entries = words.where(F.length("word") <= 64).select(F.explode(entries).alias("entry"), "pos", "neg").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    all_ = each.agg(F.sum(F.shiftright("y", 1)).alias("pos"), F.sum(F.col("y").bitwiseAND(1)).alias("neg")).first()
    rate = ((all_["pos"] or 0) + 1) / ((all_["pos"] or 0) + (all_["neg"] or 0) + 2)
    sure = (F.col("pos") >= min_clauses) & ((F.col("pos") + F.lit(PRIOR * rate)) / (F.col("pos") + F.col("neg") + F.lit(PRIOR)) > 0.5)
    found = entries.where(sure).orderBy(F.desc("pos"), "entry").limit(lexicon).collect()
    stem = spark.createDataFrame([(r["entry"],) for r in found if not r["entry"].endswith(" ")], "stem string")
    # Longer ones that are clean although they begin like one of these.
    begins = (F.substring("entry", 1, STEM) == F.substring("stem", 1, STEM)) & F.col("entry").startswith(F.col("stem"))
    clean = entries.where(~sure & (F.col("pos") + F.col("neg") >= min_clauses)).join(F.broadcast(stem), begins, "left_semi")
    found += clean.orderBy(F.desc("neg"), "entry").limit(lexicon).collect()
    weights = lexicon_of([(r["entry"], r["pos"], r["neg"]) for r in found], rate)
    fixed = set(TARGETS + NEGATIONS + REPORTS + THREATS)
    model = {"lexicon": {e: w for e, w in weights.items() if e.rstrip(" ") not in fixed}, "weights": dict(DEFAULTS), "beta": UNTAUGHT}

    def tally(grammar, text, y):
        for *_, found_ in grammar.clauses(text):
            for e in found_:
                yield e, y

    seen = _each(sample, model, tally, "event string, y int").groupBy("event", "y").agg(F.count("*").alias("n")).collect()
    model["weights"] = event_weights({(r["event"], r["y"]): r["n"] for r in seen}, rate)

    def features(grammar, text, y):
        scores = [w for _, _, w, _ in grammar.clauses(text)]
        yield y, max(scores, default=0.0), math.log1p(sum(scores))

    got = _each(sample, model, features, "y int, top double, total double").collect()
    y = np.array([r["y"] for r in got], float)
    x = np.array([(1.0, r["top"], r["total"]) for r in got]).reshape(-1, 3)
    if len(set(y.tolist())) == 2:
        model["beta"] = tuple(float(v) for v in _calibrated(x, y, np.where(y > 0, 1 / shares[1], 1 / shares[0])))
    scratch.drop()
    return model


def _each(rows: DataFrame, model: dict, f, schema: str) -> DataFrame:
    """The rows that f(grammar, text, y) gives for the rows (text, y)."""
    key = uuid.uuid4().hex
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        import pandas as pd

        grammar = once(("toxicity", key), lambda: Grammar(model["lexicon"], model["weights"]))
        for p in frames:
            out = [r for t, y in zip(p["text"], p["y"], strict=True) for r in f(grammar, t, y)]
            yield pd.DataFrame(out, columns=names)
        release()

    return rows.select("text", "y").mapInPandas(run, schema)


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """`docs` with score, predicted and clauses (which replace columns so named), by `model` of fit_toxicity.

    Texts are cut into clauses at . ! ? ; : and line ends. A word is read as it stands in fixed lists (targets,
    negations, verbs of saying, threats), and as an insult by the arcs of a weighted automaton over its letters.
    Transducers for reported speech, negation, targets, insults and threats are composed into one, and a clause's
    weight is that of the best path over all readings of its words: an insult that is negated or quoted, or a
    threat to somebody, counts as such. `score` is the calibrated chance of label 1 by the largest and the sum of the
    clauses' weights, `predicted` 1 if it is at least `threshold`; `clauses` holds start, end (code points), weight
    and events of each clause that counts.

    Null and empty texts have no clause and get the score of such texts. Rows are handled alone, whole texts of any
    length, repeated rows alike: no shuffle. An empty table gives an empty one; extra columns pass through."""
    import pyarrow as pa
    from pyspark.sql import types as T

    lean(docs.sparkSession)
    new = ("score", "predicted", "clauses")
    given = [c for c in docs.columns if c not in new]
    docs, names = numbered(docs, given, text_col)
    clause = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("events", T.ArrayType(T.StringType()))])
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("clauses", T.ArrayType(clause))])
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64()), ("events", pa.list_(pa.string()))]))

    def run(batches):
        grammar = once(("toxicity", key), lambda: Grammar(shared.value["lexicon"], shared.value["weights"]))
        for b in batches:
            found = [grammar.clauses(t.as_py() or "") for t in b.column("text")]
            score = [probability([c[2] for c in f], shared.value["beta"]) for f in found]
            shown = [[dict(zip(("start", "end", "weight", "events"), c, strict=True)) for c in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(shown, kind)], names=[*names, *new])
        release()

    return docs.mapInArrow(run, schema).toDF(*given, *new)


def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = ~held_out("doc_id", 4, 2)
    model = fit_toxicity(docs.where(taught), table(spark, sf_dir, "labels").where(taught))
    scored = score_toxicity(docs.withColumn("held_out", held_out("doc_id", 4, 2)), model, 0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op11_toxicity": op11_toxicity}
SQL: dict = {}
