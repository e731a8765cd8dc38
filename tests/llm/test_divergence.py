import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest
from helpers import rows

from millrace.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(docs, min_docs=10, top=10):
    counts, df, langs = defaultdict(Counter), Counter(), defaultdict(set)
    for _, text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        ts = [t.translate({k: k + 32 for k in range(65, 91)}) for t in TERM.findall(text)]
        counts[lang, source].update(ts)
        df.update((lang, t) for t in set(ts))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for (k, t), n in df.items() if k == lang and n >= min_docs]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 2), total + 2 * v)) for t in kept}

        gap = lambda p, q: floor(Fraction((p - q) ** 2, p + q))
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(x, sum(gap(own[s][t], own[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, gap(own[s][t], whole[t])) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:n]
                out += [(lang, s, part, x, value, k + 1) for k, (x, value) in enumerate(ranked)]
    return sorted(out, key=repr)


def made(seed, n, sources, langs=("en", "fr", None)):
    r = random.Random(seed)
    words = ["w" + "abcdefgh"[k % 8] * (1 + k // 8) for k in range(40)] + ["Été", "ÉTÉ", "日本", "×", "İx"]
    text = lambda s: " ".join(r.choice(words[: 5 + (s * 7) % 40]) + r.choice(["", ",", "1", "_", "\n"]) for _ in range(r.randint(0, 60)))
    return [(k, text(s), r.choice(langs), None if s == 3 else f"s{s}") for k in range(n) for s in [min(r.randrange(sources), r.randrange(sources))]]


@pytest.mark.parametrize(("cells", "side"), [(500_000, 128), (40, 2)])
def test_against_brute_force(spark, monkeypatch, cells, side):
    """In one block and tile, and in many."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SIDE", side)
    docs = made(3, 300, 9)
    docs += [(900, "nothing kept here qqq", "en", "lonely"), (901, None, "en", "silent"), (902, "", "xx", "a"), (903, "zzz", "xx", "b"), (904, "zzz", "xx", "c"), (905, "z", "yy", "alone")]
    docs += [(7, "hot word " * 50, "en", "s0")] * 200
    got = divergence.source_divergence(spark.createDataFrame(docs, SCHEMA), top=4)
    assert rows(got) == brute(docs, top=4)


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    docs = made(4, 120, 4)
    assert rows(divergence.source_divergence(spark.createDataFrame(docs, SCHEMA), 3)) == brute(docs, 3)


def test_shares_are_exact(spark):
    """Counts whose products pass 2^63."""
    from pyspark.sql import functions as F

    cases = [(0, 1, 1), (10**13, 10**15 + 7, 10**9), (999_999_999_937, 10**12, 3), (5, 5, 0)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    want = [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
    assert [r.p for r in got] == want and [int(divergence._shares([c], n, v)[0]) for c, n, v in cases] == want
    far = spark.createDataFrame([(10**9 + 1, 1), (3, 3)], "p long, q long").select(divergence.gap(F.col("p"), F.col("q")).alias("f")).collect()
    assert [r.f for r in far] == [10**18 // (10**9 + 2), 0]


def test_odd_rows(spark, odd_docs):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert rows(divergence.source_divergence(odd_docs, 2)) == brute(docs, 2)
    assert rows(divergence.source_divergence(odd_docs.limit(0))) == []
    clash = odd_docs.selectExpr("text AS `a.b`", "lang AS source", "source AS lang", "'x' AS term", "1 AS c", "2 AS v", "3 AS tile")
    assert rows(divergence.source_divergence(clash, 2, lang_col="source", source_col="lang", text_col="a.b")) == brute(docs, 2)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = divergence.op12_source_divergence(spark, sf_dir)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert rows(got) == brute(docs)
