import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as p
import sentencepiece
from helpers import rows
from pyspark.sql import functions as F
from test_jaccard import brute as brute_classes
from test_mixing import check as check_mix

from millrace.llm.common import Scratch
from millrace.llm.mixing import mix_sources
from millrace.llm.pieces import default_model


def one_kept(texts, hashes):
    """Every key that ten different texts hold stays in the one with the smallest hash."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(hashes[i])
    gone = lambda i, line: key(line) and len(holders[key(line)]) >= 10 and hashes[i] != min(holders[key(line)])
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}


def test_copies_leave_one_with_its_own_lines(spark):
    """Twelve copies of a text, twelve near copies of another, and a line that forty texts share."""
    word = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    whole = "\n".join(word(k, 12) for k in range(8))
    near = [word(100 + k, 12) for k in range(30)]
    docs = [(k, whole) for k in range(12)] + [(100 + k, "\n".join([*near, f"its own {k} line"])) for k in range(12)] + [(200 + k, f"{word(500 + k, 40)}\nAll rights reserved") for k in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    lined = Scratch(spark, "copies").write(p.dedup_lines(spark, df, ""), "lined")
    got = {r.doc_id: r.text for r in lined.collect()}
    assert all(got[k] == whole for k in range(12))
    assert [got[k] for k in range(100, 112)].count("\n".join(near)) == 0 and sum("\n".join(near) in got[k] for k in range(100, 112)) == 1
    assert sum("All rights" in got[k] for k in range(200, 240)) == 1
    kept = {r.doc_id: r.text for r in p.near_duplicates(spark, lined, "").collect()}
    assert [t for t in kept.values()].count(whole) == 1 and kept[0] == whole and set(range(200, 240)) <= set(kept)


def test_stages(spark, sf_dir):
    """Every stage against brute force on its own input."""
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "stages")
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == columns and out.schema == docs.schema
        out = work.write(out, name)
        after = out.collect()
        if name == "language_id":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
        elif name == "line_dedup":
            hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
            want = one_kept({r.doc_id: r.text for r in before}, hashes)
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "ngram_jaccard_join":
            classes = brute_classes([(r.doc_id, r.text) for r in before])
            blank = min((r.doc_id for r in before if not r.text.split()), default=None)
            assert {r.doc_id for r in after} == {i for i, (c, _) in classes.items() if c == i} - {r.doc_id for r in before if not r.text.split() and r.doc_id != blank}
        elif name == "mix_sources":
            got = mix_sources(docs).collect()
            check_mix(got, [(r.doc_id, r.text, r.source) for r in before])
            assert Counter(r.doc_id for r in after) == Counter({r.doc_id: r.copies for r in got if r.copies})
        else:
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            text = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            for r in after:
                ids = lib.encode(text[r.doc_id], add_eos=True)
                assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == sha(lib.decode(ids)) and r.ids_sha256 == sha(" ".join(map(str, ids)))
        docs = out


def test_run_and_odd_rows(spark, sf_dir, odd_docs, tmp_path):
    assert p.run(spark, sf_dir).count() > 50
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} <= {1, 2, 3, 8, 10, 13, 14, None}
    odd_docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert rows(p.run(spark, str(tmp_path))) == []
