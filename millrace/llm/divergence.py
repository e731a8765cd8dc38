"""Source divergence audit: how differently the sources of a language use its terms."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, column, lean, release, table

#: What every probability is a share of.
UNIT = 1_000_000_000
#: Added to every count.
PRIOR = 2
#: Distinct terms of a language and source that a task holds before it hands their counts on.
HELD = 200_000
#: Cells, about, of one block of terms, and sources of one side of a tile.
CELLS, SIDE = 500_000, 128
#: Bytes of terms as they are, A-Z in lower case, and blanks for all others.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, c, df): occurrences of each term in the texts of a language's source, and how many of
    them hold it. Terms are runs of ASCII letters and code points from U+0080 on, with A-Z in lower case.

    A task sums what it has read before it is shuffled, so a frequent term is a few rows for each task."""
    lean(docs.sparkSession)
    given = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(column(c), F.lit("")).alias(n) for n, c in given.items()])

    def count(batches):
        import pyarrow as pa

        def summed(held, dfs):
            for (lang, source), terms in held.items():
                seen = dfs[lang, source]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(terms.values(), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())], names=["lang", "source", "term", "c", "df"])

        held: dict = {}
        dfs: dict = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                key = lang, source
                if key not in held:
                    held[key], dfs[key] = Counter(), Counter()
                own, before = held[key], len(held[key])
                found = Counter(text.encode().translate(TERMS).split())
                own.update(found)
                dfs[key].update(found.keys())
                size += len(own) - before
                if size >= HELD:
                    yield from summed(held, dfs)
                    held, dfs, size = {}, {}, 0
        yield from summed(held, dfs)
        release()

    found = rows.mapInArrow(count, "lang string, source string, term string, c long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def share(c: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (c + PRIOR) / (total + PRIOR kept)), exactly, as long."""
    wide = lambda x: x.cast("decimal(27,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(c + F.lit(PRIOR)) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + F.lit(PRIOR) * kept))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, as long; below 2^63 since shares are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(counts, total: int, kept: int):
    """share() of some whole numbers, in whole numbers of any size."""
    return np.array([1 + UNIT * (int(c) + PRIOR) // (total + PRIOR * kept) for c in counts], np.int64)


def _gaps(p, q):
    return (p - q) * (p - q) // (p + q)


def tile_values(found):
    """(lang, a, b, value, present) for the pairs of sources of one block of terms: the sum of gaps over the
    block's terms that a or b has, and how many they are.

    `found` is an Arrow table of (lang, tile_a, tile_b, tile, source, n, v, term, c), a row without term for
    each source. A pair's terms are tallied by their two counts: first those that both have; what is left of each
    source's own tally are the implied cells (count, 0) and (0, count). The gap is computed once for each cell and
    multiplied by its tally."""
    import pyarrow as pa

    names, tiles, totals = {}, {}, {}
    source = found.column("source").combine_chunks().dictionary_encode()
    labels, code = source.dictionary.to_pylist(), source.indices.to_numpy(zero_copy_only=False)
    for k, tile, n in zip(code.tolist(), found.column("tile").to_pylist(), found.column("n").to_pylist(), strict=True):
        names[k], tiles[k], totals[k] = labels[k], tile, n
    kept, lang = found.column("v")[0].as_py(), found.column("lang")[0].as_py()
    tile_a, tile_b = found.column("tile_a")[0].as_py(), found.column("tile_b")[0].as_py()
    real = found.column("term").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    term = found.column("term").combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False)
    c = found.column("c").combine_chunks().to_numpy(zero_copy_only=False)
    levels = np.unique(np.concatenate([[0], c[real]]))
    level = np.searchsorted(levels, c)
    own = {}
    for k in names:
        at = np.flatnonzero(real & (code == k))
        at = at[np.argsort(term[at], kind="stable")]
        own[k] = term[at], level[at]
    p = {k: _shares(levels, totals[k], kept) for k in names} if kept else {k: None for k in names}
    tally = {k: np.bincount(x[1], minlength=len(levels)) for k, x in own.items()}
    out = []
    for i in names:
        for j in names:
            if tile_a == tile_b and names[i] >= names[j] or tile_a != tile_b and (tiles[i], tiles[j]) != (tile_a, tile_b):
                continue
            value = present = 0
            if kept:
                _, x, y = np.intersect1d(own[i][0], own[j][0], assume_unique=True, return_indices=True)
                x, y = own[i][1][x], own[j][1][y]
                cells, n = np.unique(x.astype(np.int64) * len(levels) + y, return_counts=True)
                a, b = cells // len(levels), cells % len(levels)
                value = int((_gaps(p[i][a], p[j][b]) * n).sum())
                only_i = tally[i] - np.bincount(x, minlength=len(levels))
                only_j = tally[j] - np.bincount(y, minlength=len(levels))
                value += int((_gaps(p[i], p[j][0]) * only_i).sum()) + int((_gaps(p[i][0], p[j]) * only_j).sum())
                present = len(x) + int(only_i.sum()) + int(only_j.sum())
            out.append((lang, *sorted((names[i], names[j])), value, present))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "a", "b", "value", "present"])


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source that occur together.

    A language keeps the terms that at least `min_docs` of its documents hold, V of them. Each source of it, and the
    language as a whole, gives a kept term of count c the share p = 1 + floor(10^9 (c + 2) / (N + 2 V)), N being the
    sum of its counts; the gap of two shares is floor((p - q)^2 / (p + q)). Part `pair` has each other source of
    the language, with the sum of gaps over all kept terms, those that neither source has too. Part `term` has the
    `top` terms that the source has and gives a larger share than the language, by their gap. Ranks count from 1 by
    falling value, then by the item's UTF-8. All of it is computed in whole numbers.

    Counts are summed in each task before they are shuffled. Terms are dealt into blocks by a hash, sources into
    tiles of about SIDE; a block of a tile is one group of bounded size, whatever a source's share of the rows is,
    and gives one number for each pair of its sources: pairs are never rows of terms.

    Null languages, sources and texts are read as ''. Each row is a document, rows that repeat an id too. Sources
    whose texts have no kept term have counts of 0; without kept terms, pairs have value 0. An empty table gives an
    empty one; other columns don't matter. Intermediate tables stay in `scratch` until the caller has written the
    result."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "divergence")
    counts = scratch.write(term_counts(docs, lang_col, source_col, text_col), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("c").alias("total")).where(F.col("df") >= min_docs)
    kept = scratch.write(kept.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), "total"), "kept")
    cells = scratch.write(counts.join(kept, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term"))).select("lang", "source", "term", "c", "total"), "cells")
    scratch.drop("counts")
    every = docs.select(*[F.coalesce(column(c), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]).distinct()
    sums = cells.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.sum("c").alias("n"))
    whole = kept.groupBy("_lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = every.join(sums, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")), "left").join(whole, F.col("lang") == F.col("_lang"), "left")
    zero = F.lit(0).cast("long")
    groups = scratch.write(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "n_lang")]), "groups")
    own = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "n", "v", "n_lang")
    held = cells.join(own, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")))

    p, q = share(F.col("c"), F.col("n"), F.col("v")), share(F.col("total"), F.col("n_lang"), F.col("v"))
    terms = held.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    size = cells.count()
    most = groups.groupBy("lang").agg(F.count("*").alias("s")).agg(F.max("s").alias("s")).first()["s"] or 0
    blocks, tiles = size // CELLS + 1, most // SIDE + 1
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    rows = held.select("lang", block.alias("block"), tile.alias("tile"), "source", "n", "v", "term", "c")
    there = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), tile.alias("tile"), "source", "n", "v", F.lit(None).cast("string").alias("term"), zero.alias("c"))
    rows = rows.union(there).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    rows = rows.select("lang", "block", F.least("tile", "_o").alias("tile_a"), F.greatest("tile", "_o").alias("tile_b"), "tile", "source", "n", "v", "term", "c")
    part = rows.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(tile_values, "lang string, a string, b string, value long, present long")
    pairs = part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    first = own.select(F.col("_l").alias("l1"), F.col("_s").alias("s1"), F.col("n").alias("n1"), F.col("v").alias("v1"))
    second = own.select(F.col("_l").alias("l2"), F.col("_s").alias("s2"), F.col("n").alias("n2"))
    pairs = pairs.join(first, (F.col("lang") == F.col("l1")) & (F.col("a") == F.col("s1"))).join(second, (F.col("lang") == F.col("l2")) & (F.col("b") == F.col("s2")))
    neither = gap(share(zero, F.col("n1"), F.col("v1")), share(zero, F.col("n2"), F.col("v1")))
    value = F.when(F.col("v1") > 0, F.col("value") + (F.col("v1") - F.col("present")) * neither).otherwise(zero)
    pairs = scratch.write(pairs.select("lang", "a", "b", value.alias("value")), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return both.union(terms)


def op12_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=10, top=10)


QUERIES = {"op12_source_divergence": op12_source_divergence}
SQL = {
    "op12_source_divergence": """
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
    t AS (SELECT rid, lang, source, unnest(list_transform(ts, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d),
    k AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
    g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
    c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t GROUP BY 1, 2, 3),
    z AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0) AS c FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS MATERIALIZED (SELECT lang, source, term, c, (1 + 1000000000 * (c + 2) // (sum(c) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)))::HUGEINT AS p,
        (1 + 1000000000 * (total + 2) // (sum(total) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)))::HUGEINT AS q FROM z),
    pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
    pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
}
