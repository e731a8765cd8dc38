import hashlib
import random

import pytest
import sentencepiece
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.pieces import Encoder, PieceCodec, decode, default_model, encode, load_pieces, op8_sentencepiece, round_trip


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


v = load_pieces(default_model())
CODEC = PieceCodec(v["pieces"], v["scores"], v["kinds"])
ENCODER = Encoder(CODEC)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tthe ing ▁aAé日😀\x00"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_same_as_the_library(texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    ids, ends = ENCODER.encode(texts, [2])
    for k, t in enumerate(texts):
        got = ids[ends[k] : ends[k + 1]].tolist()
        assert got == lib.encode(t, add_eos=True)
        assert CODEC.decode(got) == lib.decode(got)


def test_decode_any_ids(lib):
    r = random.Random(1)
    for _ in range(3000):
        ids = [r.choice([r.randint(0, 2), r.randint(3, 258), r.randint(200, 31999), r.randint(220, 258)]) for _ in range(r.randint(0, 8))]
        assert CODEC.decode(ids) == lib.decode(ids), ids


def test_chunks_that_polynomials_confuse(lib):
    """Chunks that a polynomial modulo 2^64 can't tell apart, in one batch and in two."""
    x = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    y = x.translate(str.maketrans("ab", "ba"))
    for batches in ([[x, y]], [[x], [y]]):
        encoder = Encoder(CODEC)
        got = [(ids[a:b].tolist()) for batch in batches for ids, ends in [encoder.encode(batch, [2])] for a, b in zip(ends, ends[1:], strict=False)]
        assert got == [lib.encode(t, add_eos=True) for t in (x, y)]


def test_matches_are_the_longest():
    """Where the automaton begins anew, it finds what a search of every prefix finds."""
    r, real = random.Random(4), {CODEC.pieces[i] for i in CODEC.own}
    for _ in range(300):
        s = "".join(r.choice("▁thernsaiou") for _ in range(r.randint(1, 30)))
        longest = [None] * (len(s) + 1)
        for pos in r.sample(range(len(s)), len(s)):
            got = CODEC._matches(s, pos, longest) if longest[pos] is None else longest[pos]
            assert CODEC.pieces[got] == next(s[pos:e] for e in range(len(s), pos, -1) if s[pos:e] in real)


def test_backtracking_needs_the_bitfield():
    """A vocabulary in which the longest match is wrong at first."""
    pieces = ["<unk>", "<s>", "</s>", "▁", "a", "b", "c", "d", "ab", "bc", "abc", "cd", "bcd"]
    scores = [0, 0, 0, -100, -101, -102, -103, -104, -3, -1, -5, -2, -4]
    codec = PieceCodec(pieces, scores, [2, 3, 3] + [1] * 10)
    for n in range(1, 7):
        r = random.Random(n)
        for _ in range(200):
            s = "".join(r.choice("abcd") for _ in range(n * 3))
            assert codec.known(s) == codec.merge(s), s


def test_query(spark, sf_dir, lib):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        ids = lib.encode(docs[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_odd_rows(spark, odd_docs, lib):
    clash = odd_docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    got = decode(encode(clash, default_model()), default_model())
    assert got.columns == ["doc_id", "text", "n_chars", "ids", "decoded"]
    for r in got.collect():
        assert r.ids == lib.encode(r.text or "", add_eos=True) and r.decoded == lib.decode(r.ids)
    both = round_trip(clash, default_model())
    assert both.columns == got.columns and rows(both) == rows(got)
    assert rows(encode(odd_docs.limit(0), default_model())) == []
    df = spark.createDataFrame([(1, None), (2, []), (3, [22557, None, 2])], "i int, ids array<int>")
    assert [r.decoded for r in decode(df, default_model()).orderBy("i").collect()] == ["", "", lib.decode([22557, 2])]
