"""Columns of the caller's whose names an operator uses itself, or that need quoting."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard, language, line_dedup, lm, mixing, neardup, pieces, url_filter, warc

NAMES = ["a.b", "t`ick", "row", "c0", "o0", "text2", "node", "grp", "key", "vec", "th", "doc", "_text", "_shard", "_ld_id", "_ld_drop", "_p", "_rate", "_mx_src", "_said", "_bad", "_digest", "_first", "part", "shard"]
MODEL = pieces.default_model()
OPERATORS = {
    "jaccard": lambda d: jaccard.jaccard_join(d),
    "line_dedup": lambda d: line_dedup.line_dedup(d, min_docs=2),
    "mixing": lambda d: mixing.mix_sources(d),
    "lm": lambda d: lm.score_texts(d, d, sweeps=1, keep=1),
    "url_filter": lambda d: url_filter.url_filter(d, url_col="text"),
    "language": lambda d: language.identify(d, language.fit_languages(d, MODEL, rounds=1)),
    "pieces": lambda d: pieces.round_trip(d, MODEL),
    "neardup": lambda d: neardup.near_duplicates(d.withColumn("v", F.array(F.lit(1.0), F.col("doc_id").cast("double"))), id_col="doc_id", vec_col="v", label_col="lang"),
    "warc": lambda d: warc.mark_revisits(d, 1, id_col="doc_id", html_col="text"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame([(1, "a b\nc", "en", "s"), (2, "a b\nd", "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    plain = OPERATORS[name](docs)
    got = OPERATORS[name](docs.select("*", *[F.lit(n).alias(n) for n in NAMES]))
    key = lambda r: repr(tuple(r[c] for c in plain.columns))
    if name in ("jaccard", "neardup"):  # they return no columns of the caller's
        assert got.columns == plain.columns
    else:
        assert [c for c in got.columns if c not in NAMES] == plain.columns and set(NAMES) <= set(got.columns)
        assert all(r[n] == n for r in got.collect() for n in NAMES)
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))
