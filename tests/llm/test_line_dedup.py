import hashlib
from collections import defaultdict

from helpers import rows

from millrace.llm.line_dedup import line_dedup, op2_line_dedup


def brute(docs, min_docs=10, min_chars=1):
    fold = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(fold(x)) >= min_chars:
                held[fold(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(fold(x), ())) < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    docs = [(i, "\n".join([f"own {i}", "Shared\u00c9 " + "x" * (i % 3), "", " shared\t", f"pair {i // 2}"] * (1 + i % 2))) for i in range(60)]
    docs += [(100 + i, "SHARED\nshared\n\u00e9") for i in range(12)] + [(200, None), (201, ""), (202, "\n\n"), (None, "SHARED\n\n\x0bshared\x0c"), (None, "null too\nshared"), (100, "SHARED\nshared\n\u00e9")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(line_dedup(df)) == brute(docs)
    assert rows(line_dedup(df, 3, 6)) == brute(docs, 3, 6)


def test_repeated_ids_count_once(spark):
    df = spark.createDataFrame([(1, "a\nb")] * 12 + [(2, "a")], "doc_id long, text string")
    assert {r.text for r in line_dedup(df).collect()} == {"a\nb", "a"}


def test_odd_rows(spark, odd_docs):
    clash = odd_docs.withColumnRenamed("lang", "n_lines").withColumnRenamed("n_chars", "_ld_x")
    got = line_dedup(clash)
    assert got.columns == ["doc_id", "text", "source", "_ld_x", "n_lines", "n_dropped"]
    assert got.count() == odd_docs.count()
    assert rows(line_dedup(odd_docs.limit(0))) == []


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(docs))
    assert rows(op2_line_dedup(spark, sf_dir)) == sorted(want, key=repr)
