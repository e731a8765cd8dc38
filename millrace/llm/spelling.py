"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, column, lean, release, table

#: Members of a bucket that are compared with each other; larger buckets are partitioned again.
LIMIT = 128
#: Parts into which a bucket's members are dealt to meet the mark of a large bucket.
SALTS = 16
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000
#: In Latin-1, a byte is a code point: letters stay, A-Z in lower case, and all else parts runs.
RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def noised(runs: Counter, prefix: bytes, every: int) -> Counter:
    """The runs (Latin-1) of one document, one code point deleted from those whose CRC-32 `every` divides."""
    start, out = zlib.crc32(prefix), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, min_chars: int = 7, noise_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often the words of at least `min_chars` code points occur in all texts. Words are maximal
    runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.

    With `noise_every`, a run loses its code point h % length (from 0) in documents where that number divides
    h, the CRC-32 of `<id>:<run>` in UTF-8: misspellings whose right spelling is known. Words are counted within
    a task before they are shuffled, so a word of a third of all texts is a few rows for each task. Null texts have
    no words, a null id counts as an empty one, and repeated rows count again; an empty table has no words, and
    other columns don't matter."""
    lean(docs.sparkSession)
    rows = docs.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"), column(text_col).alias("text")).where("text IS NOT NULL")

    def count(batches):
        import pyarrow as pa

        def given(held):
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for b in batches:
            for own, text in zip(b.column("id"), b.column("text"), strict=True):
                # No shorter run can leave a word that is long enough.
                runs = Counter(w for w in text.as_py().encode("latin-1", "replace").translate(RUNS).split() if len(w) >= min_chars)
                if noise_every:
                    runs = noised(runs, f"{own.as_py()}:".encode(), noise_every)
                held.update(runs)
                if len(held) >= HELD:
                    yield given(held)
                    held = Counter()
        yield given(held)
        release()

    found = rows.mapInArrow(count, "word string, n long").where(F.length("word") >= min_chars)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def _segments(rows: DataFrame) -> DataFrame:
    """Both segments of every row as (key, role, word, n, lo, size): the even partition of `size` code points of
    a word from `lo` on, the first half of them and the rest. A row's role is 1 for words that are one longer than
    those that `size` speaks of, whose second segment stands one further to the right. What is left of the word
    beside the segment is the next `lo` and `size`."""
    half = F.expr("size div 2")
    first = (F.lit(0), F.expr("substring(word, lo + 1, size div 2)"), F.col("lo") + half, F.col("size") - half)
    second = (F.lit(1), F.expr("substring(word, lo + role + size div 2 + 1, size - size div 2)"), F.col("lo"), half)
    parts = [F.struct(F.xxhash64("key", "size", which, text).alias("key"), lo.alias("lo"), size.cast("int").alias("size")) for which, text, lo, size in (first, second)]
    return rows.select("role", "word", "n", F.explode(F.array(*parts)).alias("s")).select("s.key", "role", "word", "n", "s.lo", "s.size")


def near_words(words: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """(a, n_a, b, n_b) for every two words (word, n) that are one edit apart, once and in both directions; `words`
    holds no word twice.

    A word is indexed by the two halves of its length: an edit leaves one of them as it is. Words of the same
    length look up their own halves, words one longer the places where the halves stand before or after the
    inserted code point. What meets is checked, and pairs that meet in both halves are taken once. Buckets of
    more than `limit` words aren't compared: their words share a segment, so what is beside it must be one
    edit apart, and that is partitioned again, until buckets are small or nothing but one code point is left. So the
    candidates of a bucket that holds a third of all words are not all its pairs, and no limit drops one."""
    rows = words.select(F.lit(0).cast("long").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), "word", "n", F.lit(0).alias("lo"))
    rows = rows.withColumn("size", (F.length("word") - F.col("role")).cast("int"))
    pairs, level = None, 0
    while True:
        found = _segments(rows)
        large = found.groupBy("key").agg(F.count("*").alias("m"), F.max("size").alias("left")).where((F.col("m") > limit) & (F.col("left") > 1)).select("key")
        large = scratch.write(large, f"large-{level}")
        marks = large.select(F.col("key").alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        salt = F.pmod(F.xxhash64("word", "role"), F.lit(SALTS))
        same = (F.col("key") == F.col("_key")) & (salt == F.col("_salt"))
        small = found.join(marks, same, "left_anti") if level or large.limit(1).count() else found
        index = small.where("role = 0").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        probe = small.select(F.col("key").alias("_key"), "role", F.col("word").alias("b"), F.col("n").alias("n_b"))
        met = index.join(probe, (F.col("key") == F.col("_key")) & ((F.col("role") == 1) | (F.col("a") < F.col("b"))) & one_edit(F.col("a"), F.col("b")))
        met = scratch.write(met.select("a", "n_a", "b", "n_b"), f"met-{level}")
        pairs = met if pairs is None else pairs.union(met)
        if not large.limit(1).count():
            break
        rows = scratch.write(found.join(marks, same, "left_semi").select("key", "role", "word", "n", "lo", "size"), f"rows-{level}")
        level += 1
    once = pairs.distinct()
    return once.union(once.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))


def spelling_variants(words: DataFrame, min_count: int = 2, ratio: int = 10, word_col: str = "word", n_col: str = "n", scratch: Scratch | None = None) -> DataFrame:
    """(word, n, form, form_n, n_near, root) for each word that occurs at least `min_count` times.

    Near words differ by one inserted, deleted or replaced code point; n_near counts them. The form is the near
    word that occurs most (of several, the first in code-point order), if it occurs at least `ratio` times as often
    as the word; else it is null, as is form_n. The root is where the forms lead: a form's form occurs more
    often still, so they lead to an end; it is the word itself if it has no form.

    Words that are null or empty don't count, nor do null counts; counts of repeated rows are summed. ValueError
    if `ratio` isn't above 1, since forms could then run in a circle. An empty table gives an empty one; other
    columns don't matter. Intermediate tables stay in `scratch` until the caller has written the result."""
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    own = words.select(column(word_col).cast("string").alias("word"), column(n_col).cast("long").alias("n")).where(F.length("word") > 0)
    own = scratch.write(own.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "words")
    near = near_words(own, scratch)
    most = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("b"))).alias("most")
    near = near.groupBy("a").agg(F.count("*").alias("n_near"), most)
    chosen = own.join(near, F.col("word") == F.col("a"), "left")
    often = -F.col("most.n") >= F.lit(ratio) * F.col("n")
    forms = chosen.select("word", "n", F.when(often, F.col("most.b")).alias("form"), F.when(often, -F.col("most.n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
    forms = scratch.write(forms, "forms")
    # Every step doubles the forms followed, so there are as many as the binary digits of the longest chain.
    ends, step = scratch.write(forms.where("form IS NOT NULL").select("word", F.col("form").alias("at")), "ends-0"), 0
    while True:
        on = ends.select(F.col("word").alias("_word"), F.col("at").alias("_at"))
        further = scratch.write(ends.join(on, F.col("at") == F.col("_word"), "left").select("word", F.coalesce("_at", "at").alias("at"), F.col("_at").isNotNull().alias("moved")), f"ends-{step + 1}")
        ends, step = further.select("word", "at"), step + 1
        if not further.where("moved").limit(1).count():
            break
    ends = ends.select(F.col("word").alias("_word"), F.col("at").alias("root"))
    return forms.join(ends, F.col("word") == F.col("_word"), "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark, sf_dir):
    words = word_counts(table(spark, sf_dir, "documents"), min_chars=7, noise_every=31)
    return spelling_variants(words, min_count=2, ratio=10)


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
SQL = {
    # The CRC-32 goes byte by byte through its table, which is made by its rule; near words share a word with one
    # code point struck out, or with a mark in its place.
    "op13_spelling_variants": """
    WITH RECURSIVE bits AS (SELECT i AS b, 0 AS k, i AS v FROM range(256) t(i) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
    d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
    r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY rid, 1, 2),
    h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))),
        lambda c, b: xor(c >> 8, list_extract(crc.t, (xor(c, b) & 255) + 1))), 4294967295) AS h FROM r, crc),
    w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
    s AS MATERIALIZED (SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: left(word, (i - 1)::INT) || '*' || substr(word, (i + 1)::INT))) AS hole FROM w),
    p AS MATERIALIZED (SELECT x.word AS a, y.word AS b, y.n FROM s x JOIN s y ON x.hole = y.hole AND x.word <> y.word
        UNION SELECT x.word, y.word, y.n FROM w x JOIN (SELECT word, n, replace(hole, '*', '') AS short FROM s) y ON x.word = y.short
        UNION SELECT y.word, x.word, x.n FROM w x JOIN (SELECT word, replace(hole, '*', '') AS short FROM s) y ON x.word = y.short),
    f AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS m FROM p GROUP BY a),
    o AS MATERIALIZED (SELECT word, n, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n, coalesce(n_near, 0) AS n_near FROM w LEFT JOIN f ON a = word),
    c AS (SELECT word, form AS fin FROM o WHERE form IS NOT NULL UNION ALL SELECT c.word, o.form FROM c JOIN o ON o.word = c.fin WHERE o.form IS NOT NULL),
    e AS (SELECT c.word, fin FROM c JOIN o ON o.word = c.fin WHERE o.form IS NULL)
    SELECT o.word, o.n::BIGINT AS n, form, form_n::BIGINT AS form_n, n_near::BIGINT AS n_near, coalesce(fin, o.word) AS root FROM o LEFT JOIN e ON e.word = o.word"""
}
