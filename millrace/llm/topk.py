"""Exact top-k search by inner product: KD-trees per shard."""

from __future__ import annotations

import heapq
import math
import pickle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import lean, partitions, table

LEAF = 64
#: Integer arithmetic in doubles is exact below this.
EXACT = 2**53


def valid(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def build_tree(ids, points) -> dict:
    """A KD-tree: nodes split at the median of their widest dimension down to LEAF points, each with the
    tight box of its points. Points stand so that every node is a range of them."""
    import numpy as np

    order, spans, kids, lo, hi, todo = np.arange(len(ids)), [], [], [], [], [(0, len(ids), None)]
    while todo:
        a, b, parent = todo.pop()
        own = points[order[a:b]]
        k = len(spans)
        if parent is not None:
            kids[parent].append(k)
        spans.append((a, b))
        kids.append([])
        lo.append(own.min(axis=0))
        hi.append(own.max(axis=0))
        if b - a > LEAF and (lo[k] != hi[k]).any():
            by = int((hi[k] - lo[k]).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, by], mid)]
            todo += [(a, a + mid, k), (a + mid, b, k)]
    return {"ids": ids[order], "points": points[order], "spans": spans, "kids": kids, "lo": np.array(lo), "hi": np.array(hi)}


def search_tree(tree: dict, ids, queries, floors, k: int):
    """(query, score, id) of each query's best k points of this tree other than its own, as far as they can
    reach `floors`, the k-th scores known so far (None: nothing known).

    Nodes are visited best first by the largest inner product that their box allows. The search ends when
    that is below the k-th score; an equal one is visited, since smaller ids win ties.
    """
    import numpy as np

    points, lo, hi = tree["points"], tree["lo"], tree["hi"]
    top = lambda x: max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if top(points) * top(queries) * points.shape[1] < EXACT:
        points, lo, hi, queries = (x.astype(np.float64) for x in (points, lo, hi, queries))
    else:
        points, lo, hi, queries = (x.astype(object) for x in (points, lo, hi, queries))
    zero = queries * 0
    bounds = np.maximum(queries, zero) @ hi.T + np.minimum(queries, zero) @ lo.T
    for n, (own, q, floor) in enumerate(zip(ids, queries, floors, strict=True)):
        best: list = []  # a heap of (score, -id)
        least = -math.inf if floor is None else floor
        heap = [(-bounds[n, 0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if tree["kids"][node]:
                for c in tree["kids"][node]:
                    if bounds[n, c] >= least:
                        heapq.heappush(heap, (-bounds[n, c], c))
                continue
            a, b = tree["spans"][node]
            scores = points[a:b] @ q
            for i in np.flatnonzero(scores >= least):
                item = (int(scores[i]), -int(tree["ids"][a + i]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k:
                    least = max(least, best[0][0])
        yield from ((own, s, -i) for s, i in best)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of `vectors` (vec_id, vec array<long>) of largest
    inner product with each row of `queries` (same columns), without the query's own id; ties go to the
    smaller vec_id; all, if there are fewer.

    Vectors are dealt by a hash of the id into shards of about `shard_rows`, each a KD-tree in one row, and
    queries into blocks of about `block_rows`; a task searches one block in one tree, so that both sides are
    bounded at any size. A block is first searched in one shard, and the k-th scores found there bound the
    search in the others. The result is exact: a box is only left out if no point in it can reach the k-th.

    Vectors of different lengths are never compared. Rows with null id or vector take no part; if an id
    occurs more than once, its smallest vector counts. Scores beyond 64 bits are held at its limits.
    Empty tables give an empty table.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    lean(spark)
    one = lambda df: df.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    vectors, queries = one(vectors.select("vec_id", "vec")), one(queries.select("vec_id", "vec"))
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    n = partitions(spark)
    bucket = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(m)).cast("int")

    def matrix(frame):
        points = np.array(frame["vec"].tolist(), np.int64).reshape(len(frame), -1)
        most = max(int(points.max()), -int(points.min()))
        return points.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)

    def build(key, frame):
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(build_tree(frame["vec_id"].to_numpy(), matrix(frame)))]})

    def pack(key, frame):
        floors = [None if x is None else int(x) for x in frame["floor"]]  # text: a float would round it
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "packed": [pickle.dumps((frame["vec_id"].to_numpy(), matrix(frame), floors))]})

    def search(frame):
        rows = [(int(q), int(max(-(2**63), min(2**63 - 1, s))), int(i)) for t, p in zip(frame["tree"], frame["packed"], strict=True) for q, s, i in search_tree(pickle.loads(t), *pickle.loads(p), k)]
        return pd.DataFrame(rows, columns=["query_id", "score", "vec_id"])

    trees = vectors.select(F.size("vec").alias("dim"), bucket(3, shards).alias("shard"), "vec_id", "vec").repartition(max(1, min(n, shards)), "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")
    asked = queries.select(F.size("vec").alias("dim"), bucket(4, blocks).alias("block"), "vec_id", "vec")
    found, packing = "query_id long, score long, vec_id long", "dim int, block int, packed binary"

    def grid(packed: DataFrame) -> DataFrame:
        tiles = packed.join(trees, ["dim", "shard"]).repartition(n, "dim", "shard", "block")
        return tiles.groupBy("dim", "shard", "block").applyInPandas(search, found)

    # Round one: each block in one shard.
    home = F.pmod("block", F.lit(shards)).cast("int")
    first = grid(asked.withColumn("floor", F.lit(None).cast("string")).groupBy("dim", "block").applyInPandas(pack, packing).withColumn("shard", home))
    if shards > 1:
        floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("string")).alias("floor"))
        # Round two: each block in all other shards, a packed row for each.
        rest = asked.join(floors, "vec_id", "left").groupBy("dim", "block").applyInPandas(pack, packing)
        rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
        first = first.union(grid(rest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    v = F.col(column)
    return embeddings.where(valid(v)).select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("vec"))


def op4_topk_search(spark, sf_dir):
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


QUERIES = {"op4_topk_search": op4_topk_search}
SQL = {
    "op4_topk_search": """
    WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM e q, e c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""
}
