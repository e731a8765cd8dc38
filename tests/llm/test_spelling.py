import random
import zlib
from collections import Counter

import pytest
from helpers import rows

from millrace.llm import spelling
from millrace.llm.common import Scratch

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute_words(docs, min_chars=7, every=31):
    out = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if ("a" <= c.lower() <= "z" and c.isascii()) or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if every and h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                out[run] += len(run) >= min_chars
                run = ""
    return {w: n for w, n in out.items() if n}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words, min_count=2, ratio=10):
    words = {w: n for w, n in words.items() if n >= min_count}
    form, near = {}, {}
    for w in words:
        near[w] = [v for v in words if one_edit(w, v)]
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, form.get(w), words[form[w]] if w in form else None, len(near[w]), root))
    return sorted(out, key=repr)


def test_words(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert dict(rows(spelling.word_counts(odd_docs, 2, 3))) == brute_words(docs, 2, 3)
    assert dict(rows(spelling.word_counts(odd_docs, 7))) == brute_words(docs, 7, None)
    assert rows(spelling.word_counts(odd_docs.limit(0))) == []
    letters = spark.createDataFrame([(1, "ÀÖ×÷ÿabc ÉaĀb¿Cd ẞſK")], "doc_id long, text string")
    assert dict(rows(spelling.word_counts(letters, 1))) == brute_words([(1, "ÀÖ×÷ÿabc ÉaĀb¿Cd ẞſK")], 1, None)


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    docs = [(k, f"alpha{'x' * (k % 5)} beta alpha") for k in range(40)]
    assert dict(rows(spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string"), 1))) == brute_words(docs, 1, None)


@pytest.mark.parametrize("limit", [1, 4, 10**6])
def test_against_brute_force(spark, limit):
    """Words of one edit and of two, at every place, with few letters and many; small buckets and none."""
    r = random.Random(5)
    words = {}
    for _ in range(60):
        w = "".join(r.choice("ab") for _ in range(r.randint(1, 7)))
        words[w] = r.randint(1, 300)
        v = "".join(r.choice(LETTERS) for _ in range(r.randint(7, 12)))
        words[v] = r.randint(100, 5000)
        for _ in range(4):
            k, c = r.randrange(len(v) + 1), r.choice(LETTERS)
            words[r.choice([v[:k] + c + v[k:], v[:k] + v[k + 1 :], v[:k] + c + v[k + 1 :], v[:k] + c + c + v[k:]])] = r.randint(1, 300)
    words |= {"y" * 400: 3, "y" * 401: 50, "y" * 200 + "z" + "y" * 199: 700}
    words.pop("", None)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = rows(spelling.near_words(df.where("n >= 2"), Scratch(spark, "test"), limit))
    kept = {w: n for w, n in words.items() if n >= 2}
    assert near == sorted(((a, kept[a], b, kept[b]) for a in kept for b in kept if one_edit(a, b)), key=repr)
    assert rows(spelling.spelling_variants(df)) == brute_variants(words)


def test_a_third_of_all_words_in_one_bucket(spark):
    """Words that share their first half, and words that share all but one code point."""
    r = random.Random(9)
    words = {"abcdefgh" + "".join(r.choice("xyzuvw") for _ in range(8)): r.randint(2, 90) for _ in range(600)}
    words |= {"qrstuvw" + c: 2 for c in LETTERS}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.spelling_variants(df)) == brute_variants(words)


def test_forms_lead_to_an_end(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaaabbbb": 20000, "zzzzzzz": 5}
    got = {r.word: r.root for r in spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {w: "aaaabbbb" for w in words} | {"zzzzzzz": "zzzzzzz"}
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_odd_rows(spark):
    odd = spark.createDataFrame([("night", 2), ("night", 3), (None, 9), ("", 9), ("nights", None), ("nighs", 60), ("a.b", 2)], "word string, n long")
    want = [("a.b", 2, None, None, 0, "a.b"), ("nighs", 60, None, None, 1, "nighs"), ("night", 5, "nighs", 60, 1, "nighs")]
    assert rows(spelling.spelling_variants(odd)) == want
    assert rows(spelling.spelling_variants(odd.limit(0))) == []
    clash = odd.selectExpr("word AS `w.x`", "n AS a", "word AS word", "'k' AS key", "1 AS lo")
    assert rows(spelling.spelling_variants(clash, word_col="w.x", n_col="a")) == want


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = spelling.op13_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "n", "form", "form_n", "n_near", "root"]
    assert rows(got) == brute_variants(brute_words(docs))
