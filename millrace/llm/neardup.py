"""Embedding near-dedup by NN-descent, with an exact check of what the descent left apart."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, column, components, lean, partitions, table, whole_ids
from millrace.llm.groups import links_and_components, runs_of, sized
from millrace.llm.topk import valid

#: Hyperplanes of a tree; a group of more rows than 2^BITS leaves has larger leaves, dealt into blocks.
BITS = 40
#: Levels of the tree of cells, at most.
LEVELS = 16


def _unit(rows):
    import numpy as np

    return np.stack([np.frombuffer(x, "<f8") for x in rows])


def scaled(x):
    """A vector times a power of two that brings its largest component to [0.5, 1): its cosines stay the same,
    and no square of it overflows or vanishes."""
    import numpy as np

    x = np.asarray(x, np.float64)
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) if len(x) and np.abs(x).max() < np.inf else x


def cosines(a, b):
    import numpy as np

    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :])


def _nearest(sims, floors, k: int):
    """(row, column) of the k largest of each row that are above the row's floor, the diagonal left out."""
    import numpy as np

    np.fill_diagonal(sims, -2.0)
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.tile(np.arange(sims.shape[1]), (sims.shape[0], 1))
    row = np.repeat(np.arange(len(sims)), part.shape[1])
    col = part.ravel()
    ok = (sims[row, col] > floors[row]) & (sims[row, col] >= -1.5)
    return row[ok], col[ok]


def _pairs(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Within each run of equal keys (key, node, vec, floor), each node's k nearest above its floor."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, (node, vec, floor) in runs_of(batches, keys, ["node", "vec", "floor"]):
            keep = [i for i in range(len(node)) if i == 0 or node[i] != node[i - 1]]
            if len(keep) < 2:
                continue
            nodes, x = np.array([node[i] for i in keep], np.int64), _unit([vec[i] for i in keep])
            sims = cosines(x, x)
            r, c = _nearest(sims, np.array([floor[i] for i in keep]), k)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[r]), pa.array(nodes[c]), pa.array(sims[r, c])], names=["u", "v", "sim"])

    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "u long, v long, sim double")


def _leaves(nodes: DataFrame, trees: range, leaf: int, block: int, k: int) -> DataFrame:
    """Neighbours to start with: random-projection trees, whose leaves (blocks of them, if large) are
    compared inside. A leaf is the sides of a vector against as many hyperplanes as its group needs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        planes: dict = {}
        for b in batches:
            group, bits = b.column("grp").to_numpy(), b.column("bits").to_numpy()
            vecs = [np.frombuffer(x, "<f8") for x in b.column("vec").to_pylist()]
            for t in trees:
                code = np.zeros(len(vecs), np.int64)
                for dim in {len(v) for v in vecs}:
                    at = np.array([i for i, v in enumerate(vecs) if len(v) == dim])
                    if (t, dim) not in planes:
                        planes[t, dim] = np.random.default_rng([t, dim]).standard_normal((dim, BITS))
                    side = (np.stack([vecs[i] for i in at]) @ planes[t, dim] > 0) & (np.arange(BITS)[None, :] < bits[at][:, None])
                    code[at] = side @ (1 << np.arange(BITS, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vecs), t)), pa.array(group), pa.array(code), b.column("node"), b.column("vec")], names=["tree", "grp", "code", "node", "vec"])

    rows = sized(nodes, ["grp"], F.least(F.lit(BITS), F.ceil(F.log2(F.count("*") / F.lit(leaf)))), "bits", 0).select("grp", "bits", "node", "vec").mapInArrow(run, "tree long, grp long, code long, node long, vec binary")
    rows = rows.withColumn("leaf", F.xxhash64("tree", "grp", "code")).select("leaf", "node", "vec")
    rows = sized(rows, ["leaf"], F.ceil(F.count("*") / F.lit(block)), "blocks", 1).withColumn("part", F.xxhash64("leaf", F.pmod(F.xxhash64(F.lit(2), "node"), "blocks")))
    return _pairs(rows.select("part", "node", "vec", F.lit(-1.5).alias("floor")), ["part"], k)


def _lists(pairs: DataFrame, caps: DataFrame | None, k: int, threshold: float, widest: int) -> DataFrame:
    """(u, cap, near): each node's nearest by similarity. A list is saturated if it is full and every entry
    reaches the threshold; it may then hold twice as many from the next round on, up to `widest`."""
    # A node that many lists hold gets many offers: they are ranked by a sort, and few reach one row.
    best = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), F.desc("v")))).where(F.col("r") <= widest)
    got = best.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False).alias("near"))
    got = got.join(caps.select(F.col("u").alias("_u"), "cap"), F.col("u") == F.col("_u"), "left").drop("_u") if caps is not None else got.withColumn("cap", F.lit(None).cast("int"))
    got = got.withColumn("cap", F.coalesce("cap", F.lit(k))).withColumn("near", F.expr("slice(near, 1, cap)"))
    full = (F.size("near") >= F.col("cap")) & (F.element_at("near", -1)["sim"] >= threshold)
    return got.select("u", F.when(full, F.least(F.col("cap") * 2, F.lit(widest))).otherwise(F.col("cap")).cast("int").alias("cap"), "near")


class Cells:
    """A tree of cells: at level l a point goes by its coordinate along the l-th of some orthonormal directions,
    against a threshold of its own for every node. A point's distance to a cell is at least the root of the
    summed squares of its distances to the thresholds that part them."""

    def __init__(self, sample):
        """Directions in which the sample is widest; thresholds are its medians, node by node."""
        import numpy as np

        _, vectors = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1))
        self.axes = vectors[:, ::-1][:, :LEVELS]
        at, along, self.cuts = np.zeros(len(sample), np.int64), sample @ self.axes, []
        for level in range(self.axes.shape[1]):
            order = np.lexsort((along[:, level], at))
            count = np.bincount(at, minlength=1 << level)
            middle = np.minimum(np.cumsum(count) - count + count // 2, len(sample) - 1)
            cut = np.where(count > 0, along[order, level][middle], 0.0)
            self.cuts.append(cut)
            at = at * 2 + (along[:, level] >= cut[at])

    def reached(self, points, radius, levels):
        """(point, cell, whether it is the point's own) of all cells that may hold something within `radius`
        of the points; cells are nodes `levels` below the root."""
        import numpy as np

        along = points @ self.axes
        row, at, far = np.arange(len(points)), np.zeros(len(points), np.int64), np.zeros(len(points))
        own, done = np.ones(len(points), bool), []
        for level in range(min(LEVELS, self.axes.shape[1]) + 1):
            ready = levels[row] == level
            done.append((row[ready], at[ready], own[ready]))
            row, at, far, own = row[~ready], at[~ready], far[~ready], own[~ready]
            if not len(row):
                break
            gap = along[row, level] - self.cuts[level][at]
            near = gap >= 0
            other = far + gap * gap
            cross = other <= radius[row] ** 2
            row, far = np.concatenate([row, row[cross]]), np.concatenate([far, other[cross]])
            at, own = np.concatenate([at * 2 + near, (at * 2 + ~near)[cross]]), np.concatenate([own, np.zeros(int(cross.sum()), bool)])
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _apart(units: DataFrame, threshold: float, leaf: int, sample_rows: int) -> DataFrame:
    """The exact check: (a, b), roots of different components, for all units (grp, node, root, vec of length one,
    radius) of one group that may hold a pair of vectors whose cosine reaches the threshold; for two units of one
    vector each, only those that do.

    Vectors are points on a sphere, where the threshold is a distance. Every unit has a home in a tree of cells,
    fitted on `sample_rows` of them, and visits all cells that its reach touches; in a cell, the visitors are compared
    with those who live there, who are dealt into blocks if they are many. No pair in reach can be missed, and units
    that are far apart are never compared.
    """
    import numpy as np

    spark = units.sparkSession
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-7
    share = min(1.0, sample_rows / max(1, units.count()))
    picked = units.where(F.xxhash64(F.lit(5), "vec") <= F.lit(int(-(2**63) + share * (2**64 - 2**12)))).select("vec").collect()
    sample: dict = {}
    for r in picked:
        sample.setdefault(len(r["vec"]) // 8, []).append(np.frombuffer(r["vec"], "<f8"))
    cells = spark.sparkContext.broadcast({d: Cells(np.stack(x)) for d, x in sample.items() if len(x) > 1})
    rows = sized(units, ["grp"], F.least(F.lit(LEVELS), F.ceil(F.log2(F.count("*") / F.lit(leaf)))), "levels", 0).select("grp", "levels", "root", "vec", "radius")

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            vecs, radius, levels = b.column("vec").to_pylist(), b.column("radius").to_numpy(), b.column("levels").to_numpy()
            dims = np.array([len(v) // 8 for v in vecs], np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x, tree = _unit([vecs[i] for i in at]), cells.value.get(d)
                if tree is None:
                    row, cell, own = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                else:
                    # What a component reaches beyond its radius may be another component's, of half the reach at most.
                    wide = reach + radius[at] + np.where(radius[at] > 0, reach / 2, 0.0)
                    row, cell, own = tree.reached(x, wide, np.minimum(levels[at], tree.axes.shape[1]))
                for lo in range(0, len(row), 2000):
                    k = at[row[lo : lo + 2000]]
                    yield pa.RecordBatch.from_arrays([b.column("grp").take(pa.array(k)), pa.array(cell[lo : lo + 2000]), pa.array(own[lo : lo + 2000].astype(np.int32)), b.column("root").take(pa.array(k)), b.column("vec").take(pa.array(k)), b.column("radius").take(pa.array(k))], names=["grp", "cell", "own", "root", "vec", "radius"])

    placed = rows.mapInArrow(place, "grp long, cell long, own int, root long, vec binary, radius double")
    # Where more than twice a leaf live in a cell, they are dealt into blocks, each of which all visitors see.
    placed = sized(placed, ["grp", "cell"], F.ceil(F.sum("own") / F.lit(2 * leaf)), "blocks", 1)
    home = F.pmod(F.xxhash64(F.lit(11), "vec"), "blocks").cast("int")
    visits = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lives", (F.col("own") == 1) & (F.col("block") == home))
    visits = visits.select("grp", "cell", "block", (~F.col("lives")).cast("int").alias("guest"), "root", "vec", "radius")
    visits = visits.repartition(partitions(spark), "grp", "cell", "block").sortWithinPartitions("grp", "cell", "block", "guest")

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        key, homes = None, None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grp", "cell", "block")], axis=1)
            guest, root, radius = b.column("guest").to_numpy(), b.column("root").to_numpy(), b.column("radius").to_numpy()
            vec = b.column("vec").to_pylist()
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if (this := tuple(keys[lo].tolist())) != key:
                    key, homes = this, []
                x, n, r = _unit(vec[lo:hi]), root[lo:hi], radius[lo:hi]
                lives = guest[lo:hi] == 0
                if lives.any():
                    homes.append((x[lives], n[lives], r[lives]))
                # Those who live here come first: each batch of them meets those before it and itself, guests meet all.
                for hx, hn, hr in homes:
                    far = np.sqrt(np.maximum(0.0, (hx * hx).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2.0 * hx @ x.T))
                    single = (hr[:, None] == 0) & (r[None, :] == 0)
                    hit = np.where(single, cosines(hx, x) >= threshold, far <= reach + hr[:, None] + r[None, :]) & (hn[:, None] != n[None, :])
                    i, j = np.nonzero(hit)
                    if len(i):  # one pair of each two components is enough
                        a, b_ = np.unique(np.stack([hn[i], n[j]]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_)], names=["a", "b"])

    return visits.mapInArrow(meet, "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = 8, trees: int = 4, leaf: int = 128, block: int = 512, widest: int = 64, rounds: int = 3, settled: float = 0.02, cell: int = 2048, sample_rows: int = 20_000, report: dict | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal label whose cosine, in doubles, is at least `threshold`: one row per row of
    `vectors` with vec_id, n_links, component_id and kept.

    NN-descent: each node has a list of its nearest so far, begun from `trees` random-projection trees. In
    a round, every node compares its neighbours and those it is a neighbour of with each other, and the
    lists take what is nearer. Lists that are full of links are widened, up to `widest`. Rounds end when one adds
    less than `settled` to the links, or after `rounds`.

    The descent alone can miss links; an exact check follows (see _apart). Of the components that the links made,
    those of a small radius are each one ball, all other nodes stand alone; balls and nodes that may hold a link
    between them are joined. The components are then compared exactly, in blocks, which counts every link inside
    them and leaves none below the threshold. So lists, rounds and samples bound work, and never the result. `report`
    gets the audit: the nodes (nodes), the links of the descent (links), and how many of the true components' joins
    the descent had found (recall, 1 if there are none).

    n_links counts the other vectors linked directly; component_id is the smallest vec_id that links reach;
    kept says that it is the row's own. Equal vectors are one node, so copies never make pairs. Null labels,
    null ids, null or zero vectors and vectors with null or non-finite components link with nothing (a
    null id has a null component and is not kept); vectors of different lengths don't link. Ids are whole numbers
    (others raise ValueError). Repeated rows count as one vector. Vectors are known by 128 bits of a digest, once a power of
    two has brought them to one size. Other columns of `vectors`, whatever their names, are left out. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    work = Scratch(spark, "neardup")
    lean(spark)
    vec = F.transform(column(vec_col), lambda x: x.cast("double"))
    ok = valid(column(vec_col)) & F.exists(column(vec_col), lambda x: x != 0) & column(label_col).isNotNull()
    rows = vectors.select(whole_ids(vectors, id_col).alias("id"), F.when(ok, F.xxhash64(column(label_col), F.size(column(vec_col)))).alias("grp"), F.when(ok, vec).alias("vec"))

    def packed(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            raw = pa.array([None if x is None else scaled(x).astype("<f8").tobytes() for x in b.column("vec").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grp"), raw], names=["id", "grp", "vec"])

    rows = rows.mapInArrow(packed, "id long, grp long, vec binary").withColumn("key", F.unhex(F.md5("vec")))
    rows = work.write(rows, "rows")
    ready = rows.where("grp IS NOT NULL AND id IS NOT NULL").groupBy("grp", "key").agg(F.min("id").alias("first"), F.count_distinct("id").alias("w"), F.first("vec").alias("vec"))
    # The number that a node is known by is given once, as the table is written.
    nodes = work.write(ready.select(F.monotonically_increasing_id().alias("node"), "grp", "key", "vec", "first", "w"), "nodes")

    lists, found, seen = work.write(_lists(_leaves(nodes, range(trees), leaf, block, k), None, k, threshold, widest), "lists-0"), None, -1
    for step in range(1, rounds + 1):
        # Neighbours of neighbours: around each node, those in its list and up to as many that list it.
        out = lists.select("u", F.explode(F.col("near.v")).alias("v"))
        back = out.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64(F.lit(step), "u")))).where(F.col("r") <= k).select(F.col("v").alias("c"), F.col("u").alias("m"))
        around = out.select(F.col("u").alias("c"), F.col("v").alias("m")).union(back).union(lists.select(F.col("u").alias("c"), F.col("u").alias("m"))).distinct()
        floors = lists.select(F.col("u").alias("m2"), F.when(F.size("near") >= F.col("cap"), F.element_at("near", -1)["sim"]).otherwise(-1.5).alias("floor"))
        known = work.write(nodes.select("node", "vec").join(floors, F.col("node") == F.col("m2")).select("node", "vec", "floor"), f"known-{step}")
        better = _pairs(around.join(known, F.col("m") == F.col("node")).select("c", "node", "vec", "floor"), ["c"], 3)
        pairs = lists.select("u", F.explode("near").alias("x")).select("u", "x.v", "x.sim").union(better)
        lists = work.write(_lists(pairs, lists, k, threshold, widest), f"lists-{step}")
        for t in (f"known-{step}", f"lists-{step - 1}"):
            work.drop(t)
        linked = lists.agg(F.sum(F.size(F.filter("near", lambda x: x["sim"] >= threshold)))).first()[0] or 0
        if linked <= seen * (1 + settled):
            break
        seen = linked
    links = lists.select("u", F.explode("near").alias("x")).where(F.col("x.sim") >= threshold).select(F.col("u").alias("a"), F.col("x.v").alias("b"))
    links = work.write(links, "links")
    found = work.write(components(links, work, "near"), "near")

    units = _units(nodes, found, threshold)
    joined = work.write(_apart(work.write(units, "units"), threshold, cell, sample_rows), "joined")
    whole = work.write(components(links.union(joined), work, "whole"), "whole")

    def compare(left, right, same):
        a = _unit(left[0])
        return cosines(a, a if same else _unit(right[0])) >= threshold

    members = whole.select("node", F.col("root").alias("grp")).join(nodes.select(F.col("node").alias("_n"), "w", "vec"), F.col("node") == F.col("_n")).select("node", "grp", "w", F.octet_length("vec").cast("long").alias("size"), "vec")
    links = links_and_components(members, compare, ["vec"], work, per_block=block, block_bytes=8 << 20)
    roots = nodes.select("node", "grp", "key", "first", "w").join(links.select(F.col("node").alias("_l"), "links", "root"), F.col("node") == F.col("_l"), "left")
    roots = work.write(roots.select("node", "grp", "key", "first", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "roots")
    least = roots.groupBy(F.col("root").alias("_r")).agg(F.min("first").alias("class"))
    final = work.write(roots.join(least, F.col("root") == F.col("_r")).select(F.col("grp").alias("_g"), F.col("key").alias("_k"), "class", (F.col("links") + F.col("w") - 1).alias("links")), "final")
    if report is not None:
        made = found.agg(F.count("*") - F.count_distinct("root")).first()[0]
        true = roots.agg(F.count("*") - F.count_distinct("root")).first()[0]
        report.update(nodes=nodes.count(), links=seen, recall=made / true if true else 1.0)
    work.keep("rows", "final")
    got = rows.select("id", "grp", "key").join(final, (F.when(F.col("id").isNotNull(), F.col("grp")) == F.col("_g")) & (F.col("key") == F.col("_k")), "left")
    own = F.coalesce("class", "id")
    return got.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def _units(nodes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(grp, root, vec, radius): each component of the links whose nodes lie within a quarter of the threshold's
    distance of its root is one ball around the root; every other node is a point of its own. Vectors have length one.
    A component's root is its member with the smallest number."""

    def lengths(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = [np.frombuffer(v, "<f8") for v in b.column("vec").to_pylist()]
            raw = pa.array([(v / np.sqrt(v @ v)).astype("<f8").tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("node"), b.column("root"), raw], names=["grp", "node", "root", "vec"])

    def radii(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            far = [float(np.sqrt(((np.frombuffer(v, "<f8") - np.frombuffer(c, "<f8")) ** 2).sum())) for v, c in zip(b.column("vec").to_pylist(), b.column("centre").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("root"), pa.array(far, pa.float64())], names=["root", "far"])

    roots = found.select(F.col("node").alias("_n"), "root")
    one = nodes.join(roots, F.col("node") == F.col("_n"), "left").select("grp", "node", "root", "vec").mapInArrow(lengths, "grp long, node long, root long, vec binary")
    centres = one.where("node = root").select(F.col("root").alias("_root"), F.col("vec").alias("centre"))
    far = one.where("root IS NOT NULL").join(centres, F.col("root") == F.col("_root")).select("root", "vec", "centre").mapInArrow(radii, "root long, far double")
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) / 2
    balls = far.groupBy(F.col("root").alias("_root")).agg(F.max("far").alias("radius")).where(F.col("radius") <= limit)
    out = one.join(balls, F.col("root") == F.col("_root"), "left")
    # A ball of equal directions still is one: it stands for several nodes.
    radius = F.when(F.col("_root").isNotNull(), F.greatest("radius", F.lit(1e-9))).otherwise(F.lit(0.0))
    return out.where(F.col("_root").isNull() | (F.col("node") == F.col("root"))).select("grp", F.coalesce("root", "node").alias("root"), "vec", radius.alias("radius"))


def op9_embedding_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {"op9_embedding_neardup": op9_embedding_neardup}
SQL = {
    "op9_embedding_neardup": """
    WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
    p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98),
    r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id WHERE r.root < p.b),
    c AS (SELECT id, min(root) AS root FROM r GROUP BY 1), l AS (SELECT a, count(DISTINCT b) AS n FROM p GROUP BY 1)
    SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, c.root AS component_id, c.root = vec_id AS kept FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN l ON l.a = vec_id"""
}
