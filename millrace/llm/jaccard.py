"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, column, components, forget, lean, release, table, whole_ids
from millrace.llm.groups import compare_groups, links_and_components
from millrace.llm.words import FACTOR, digest, mix, word_hashes

WORDS = 5
#: Runs that one pass over the texts samples.
RUNS = 20
#: Hash values of a set that its sketch keeps.
SKETCH = 64
#: Tokens in common that a pair at the threshold expects where a bucket is split again. More than one, so that its
#: chance to stay together does not vanish with the depth: one pass of RUNS runs is enough at any.
AGAIN = 1.4
#: Rows of 64 bits, at most, that tell which texts are asked for.
BITMAP = 1 << 19


def shingles(text: str | None, words: int = WORDS):
    """The sorted distinct hashes of a text's runs of `words` words (lower-cased, split at blanks); a shorter
    text that has words is one shingle."""
    import numpy as np

    h = word_hashes((text or "").lower().encode())
    if not len(h):
        return h
    span, step = min(words, len(h)), np.uint64(FACTOR)
    out = np.zeros(len(h) - span + 1, np.uint64)
    for k in range(span):
        out = out * step + h[k : k + len(out)]
    out = np.sort(mix(out ^ np.uint64(span)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def chosen(h, paths, lam: float, shared: float = 1.0):
    """The children of `paths` for a set: of its tokens those whose hash under the path, a product with an
    odd number of the path's own, is among the shared / (lam * size) smallest, so that two sets as similar as
    `lam` expect `shared` tokens in common. A child's name is mixed from path and token."""
    import numpy as np

    limit, odd = np.uint64(min(2**64 - 1, int(2**64 * shared / (lam * len(h))))), mix(paths) | np.uint64(1)
    got = []
    for lo in range(0, len(h), 1 << 14):
        v = h[None, lo : lo + (1 << 14)] * odd[:, None]
        row, col = np.nonzero(v <= limit)
        got.append(mix(v[row, col] ^ paths[row]))
    return np.concatenate(got).view(np.int64)


def set_key(h) -> bytes:
    """A digest of 128 bits, by which equal sets are known."""
    return digest(h.tobytes(), 16)


def overlaps(left: list, right: list):
    """Sizes of the intersections of sorted distinct arrays, as a matrix; memory is bounded by slices."""
    import numpy as np

    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    every = left if left is right else [*left, *right]
    _, code, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])[shared]
    _, code = np.unique(code[shared], return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out, cut = np.zeros((len(left), len(right))), 0 if left is right else len(left)
    top = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, top, 4096):
        a, b = np.searchsorted(code, (lo, lo + 4096))
        hot = np.zeros((len(every), min(4096, top - lo)), np.float32)
        hot[row[a:b], code[a:b] - lo] = 1
        out += hot[: len(left)] @ hot[cut:].T
    return out


def similar_sets(threshold: float, words: int):
    def compare(left, right, same):
        import numpy as np

        a = [shingles(t, words) for t in left[0]]
        b = a if same else [shingles(t, words) for t in right[0]]
        both = overlaps(a, b)
        total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both
        return both / np.maximum(total, 1) >= threshold

    return compare


def similar_sketches(threshold: float):
    """Sets that may reach the threshold: sizes that allow it, and half of the smaller sketch in common,
    six deviations below what it expects."""

    def compare(left, right, same):
        import numpy as np

        a = [np.frombuffer(x, np.uint32) for x in left[0]]
        b = a if same else [np.frombuffer(x, np.uint32) for x in right[0]]
        n, m = np.array(left[1])[:, None], np.array(right[1])[None, :]
        small = np.minimum(np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :])
        return (np.minimum(n, m) >= threshold * np.maximum(n, m)) & (overlaps(a, b) >= 0.5 * small)

    return compare


def _sets(docs: DataFrame, threshold: float, words: int) -> DataFrame:
    """For each document: doc, n (shingles), key (of the set), sketch and the children of RUNS roots."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        forget()
        roots = np.arange(1, RUNS + 1, dtype=np.uint64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, n, key, sketch, kids = b.slice(lo, 256), [], [], [], []
                for t in part.column("text").to_pylist():
                    h = shingles(t, words)
                    n.append(len(h))
                    key.append(set_key(h) if len(h) else None)
                    sketch.append((h[:SKETCH] >> np.uint64(32)).astype(np.uint32))
                    sketch[-1] = np.unique(sketch[-1]).tobytes()
                    kids.append(np.unique(chosen(h, roots, threshold)) if len(h) else h.view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in kids])]).astype("i4")
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kids)))], names=["doc", "th", "n", "key", "sketch", "kids"])
        release()

    return docs.mapInArrow(run, "doc long, th long, n long, key binary, sketch binary, kids array<long>")


def met(depth: int) -> float:
    """The probability that a pair at the threshold shares a bucket of one run at that depth."""
    below = 1.0
    for _ in range(depth - 1):
        below = 1 - math.exp(-AGAIN * below)
    return 1 - math.exp(-below)


def _split(rows: DataFrame, threshold: float, words: int, shared: float) -> DataFrame:
    """The children of (text, node, key, grps): (grp, node) below each of the set's buckets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for t, node, key, grps in zip(*(b.column(c).to_pylist() for c in ("text", "node", "key", "grps")), strict=True):
                h = shingles(t, words)
                if len(h) and set_key(h) == key:
                    paths = np.array(grps, np.int64).view(np.uint64)
                    kids = np.unique(np.concatenate([chosen(h, paths[k : k + 16], threshold, shared) for k in range(0, len(paths), 16)]))
                    yield pa.RecordBatch.from_arrays([pa.array(kids, pa.int64()), pa.array(np.full(len(kids), node), pa.int64())], names=["grp", "node"])
        release()

    return rows.mapInArrow(run, "grp long, node long")


def asked_for(texts: DataFrame, which: DataFrame, total: int) -> DataFrame:
    """The rows of `texts` whose th is one of `which`, and a few more that share a bit with one: a filter of bounded
    size before a shuffle of whole texts. `which` has some of `total` values."""
    rows = min(BITMAP, 1 << max(4, math.ceil(math.log2(max(1, total) / 4))))
    row, bit = F.pmod("th", F.lit(rows)), F.expr("shiftleft(1L, cast(pmod(shiftright(th, 32), 64) as int))")
    bits = which.groupBy(row.alias("_row")).agg(F.bit_or(bit).alias("_bits"))
    return texts.join(F.broadcast(bits), (row == F.col("_row")) & (bit.bitwiseAND(F.col("_bits")) != 0), "left_semi")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, words: int = WORDS, recall: float = 0.9999, small: int = 1024, block: int = 1024, max_depth: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Joins documents whose sets of `words`-word shingles are at least `threshold` similar: one row per row
    of `docs` with doc_id, class_id and n_links.

    n_links counts the other documents that are linked directly, equal sets included; class_id is the
    smallest doc_id that links reach. Equal sets are one node throughout, so copies never make pairs.

    Chosen paths: in every run, a set joins the buckets of the tokens that a hash of the path picks from it,
    about 1 / threshold of them, and AGAIN / threshold where a bucket is split again. Buckets of more than `small` sets are split again by their sets' tokens, as
    deep as the logarithm of the number of sets asks for (or to `max_depth`), unless a split leaves as many sets in
    large buckets as it found: those can't be told apart, and are compared by brute force on sketches, like
    small buckets, in blocks of `block`. A pair at the threshold shares a bucket in one run with a probability of
    1 - exp(-1) at depth one, and of 0.4 at least at any (see met); runs are repeated until none is missed with
    probability `recall`. The components of the candidates are compared exactly, text by text, in blocks, so
    no link has less than the threshold, and links that the buckets missed inside a component are found too.

    Null, empty and blank texts have no shingles: no links, a class of their own. Shorter texts are one
    shingle. Ids are whole numbers (others raise ValueError). Rows with null id link with nothing and have null
    class. Repeated rows count as one document, each with a result row; an id with several texts is counted once
    for each set. Words and shingles are known by 64 bits of a digest inside a pair of texts, sets by 128. Other
    columns of `docs`, whatever their names, are left out. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "jaccard")
    lean(spark)
    texts = docs.select(whole_ids(docs, id_col).alias("doc"), F.xxhash64(column(text_col)).alias("th"), column(text_col).alias("text"))
    sets = work.write(_sets(texts, threshold, words), "sets")
    known = sets.where("key IS NOT NULL AND doc IS NOT NULL")
    firsts = known.groupBy("key").agg(F.min(F.struct("doc", "th")).alias("first"), F.count_distinct("doc").alias("w"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("kids").alias("kids"))
    # The number that a set is known by from here on is given once, as the table is written.
    nodes = work.write(firsts.select(F.monotonically_increasing_id().alias("node"), "key", "first.doc", "first.th", "w", "n", "sketch", "kids"), "nodes")
    placed = work.write(sets.select("doc", "key"), "placed")
    work.drop("sets")
    total = nodes.count()
    deepest = max_depth or 2 + int(math.log(max(1.0, total / small), 16))

    def text_of(which: DataFrame, name: str) -> DataFrame:
        """`which` (node, ...) with the text and key of each node's first document."""
        firsts = work.write(which.join(nodes.select(F.col("node").alias("_n"), "key", "doc", "th"), F.col("node") == F.col("_n")).drop("_n"), name)
        return firsts.join(asked_for(texts, firsts, total), ["doc", "th"]).drop("doc", "th")

    def linked(buckets: DataFrame, edges: DataFrame | None, name: str) -> DataFrame:
        """`edges` and the candidates among the members of `buckets` (grp, node)."""
        members = buckets.select("grp", "node").join(nodes.select(F.col("node").alias("_n"), "sketch", "n"), F.col("node") == F.col("_n"))
        members = members.select("grp", "node", F.lit(1).cast("long").alias("w"), F.lit(4 * SKETCH).cast("long").alias("size"), "sketch", "n")
        found = compare_groups(members, similar_sketches(threshold), ["sketch", "n"], per_block=block, block_bytes=1 << 30, count=False)
        found = work.write(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), name)
        return found if edges is None else edges.union(found)

    def linked_large(buckets: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """The same for buckets (grp, node, c) of several blocks, whose pairs are many. A group of near copies fills
        many of them: each set's largest is compared, and of the others those whose members the links so far don't
        join into one component. The components are the same."""
        top = buckets.groupBy("node").agg(F.max(F.struct("c", "grp")).alias("top")).select("top.grp").distinct()
        edges = linked(buckets.join(top, "grp", "left_semi"), edges, f"{name}-top")
        rest = buckets.join(top, "grp", "left_anti")
        roots = components(edges, work, name).select(F.col("node").alias("_r"), "root")
        rest = work.write(rest.join(roots, F.col("node") == F.col("_r"), "left").select("grp", "node", F.coalesce("root", "node").alias("root")), f"{name}-rest")
        apart = rest.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("grp")
        return linked(rest.join(apart, "grp", "left_semi"), edges, name)

    at, missed, batch, edges = nodes.select(F.explode("kids").alias("grp"), "node"), 1.0, 0, None
    while True:
        depth, ready, before = 1, [], None
        while True:
            at = work.write(at, f"at-{batch}-{depth}")
            counts = at.groupBy("grp").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("c > 1")
            # Runs often give the same bucket again: one of those with equal members is enough.
            counts = work.write(counts.groupBy("c", "x", "y").agg(F.min("grp").alias("grp")), f"counts-{batch}-{depth}")
            over = counts.agg(F.sum(F.when(F.col("c") > small, F.col("c")))).first()[0] or 0
            large = over > 0 and depth < deepest and (before is None or over < 0.8 * before)
            before = over
            pick = counts.where(F.col("c") <= small) if large else counts
            ready.append(at.join(pick.select("grp", "c"), "grp"))
            if not large:
                break
            deep = at.join(counts.where(F.col("c") > small).select("grp"), "grp", "left_semi").groupBy("node").agg(F.collect_list("grp").alias("grps"))
            at, depth = _split(text_of(deep, f"deep-{batch}-{depth}"), threshold, words, AGAIN).distinct(), depth + 1
        for k, r in enumerate(ready):
            edges = linked(r.where(F.col("c") <= block), edges, f"edges-{batch}-{k}")
        large = reduce(DataFrame.union, (r.where(F.col("c") > block) for r in ready))
        if over > 0 or small > block:
            edges = linked_large(work.write(large, f"large-{batch}"), edges, f"edges-{batch}-large")
            work.drop(f"large-{batch}")
        for k in range(1, depth + 1):
            work.drop(f"at-{batch}-{k}")
        missed, batch = missed * (1 - met(depth)) ** RUNS, batch + 1
        if 1 - missed >= recall:
            break
        seeds = F.array(*[F.lit(batch * RUNS + k + 1).cast("long") for k in range(RUNS)])
        every = nodes.select("node", seeds.alias("grps"))
        at = _split(text_of(every, f"every-{batch}"), threshold, words, 1.0).distinct()
    groups = components(edges, work, "candidates")
    members = text_of(groups.join(nodes.select(F.col("node").alias("_m"), "w", "n"), F.col("node") == F.col("_m")).select("node", F.col("root").alias("grp"), "w", (F.col("n") * 16).alias("size")), "members")
    links = links_and_components(members, similar_sets(threshold, words), ["text"], work, per_block=block)
    roots = nodes.join(links.select(F.col("node").alias("_l"), "links", "root"), F.col("node") == F.col("_l"), "left").select("key", "doc", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    roots = work.write(roots, "roots")
    least = roots.groupBy("root").agg(F.min("doc").alias("class"))
    final = work.write(roots.join(least, "root").select(F.col("key").alias("_f"), "class", (F.col("links") + F.col("w") - 1).alias("links")), "final")
    work.keep("placed", "final")
    out = placed.join(final, F.when(F.col("doc").isNotNull(), F.col("key")) == F.col("_f"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("class", "doc").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
SQL: dict = {}
