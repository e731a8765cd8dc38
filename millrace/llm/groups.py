"""Comparing all members of a group exactly, in blocks, without writing its pairs out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, components, lean, partitions, release


#: Parts of a large group's members where they learn its size.
SALTS = 16


def sized(rows: DataFrame, on: list[str], size: Column, name: str, least: int) -> DataFrame:
    """`rows` with an int column `name`, `size` of all rows with the same values of `on`, `least` at least. Only
    groups above that have a row in the join, which are few, and one for each of SALTS parts of the group, so that no
    task of the join holds a large group whole. The rows of a part are those with one hash of all other columns."""
    large = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(size.cast("int").alias(name)).where(F.col(name) > least)
    large = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int") == F.col("_salt")
    for c in on:
        salt &= F.col(c) == F.col(f"_{c}")
    return rows.join(large, salt, "left").select(*rows.columns, F.coalesce(name, F.lit(least)).alias(name))


def runs_of(batches, keys: list[str], values: list[str]) -> Iterator[tuple]:
    """(key, columns of values as lists) of each run of equal keys in sorted Arrow batches."""
    import numpy as np

    key, held = None, [[] for _ in values]
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        cols = [b.column(c).to_pylist() for c in values]
        cuts = [0, *(np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(k[lo].tolist())
            if this != key:
                if key is not None:
                    yield key, held
                key, held = this, [c[lo:hi] for c in cols]
            else:
                for h, c in zip(held, cols, strict=True):
                    h += c[lo:hi]
    if key is not None:
        yield key, held


def roots_of(linked):
    """The smallest index that links reach, for each index of a boolean matrix."""
    import numpy as np

    n = len(linked)
    label = np.arange(n)
    linked = linked | linked.T | np.eye(n, dtype=bool)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def inner_roots(nodes, linked, cut: int):
    """The smallest node of each component inside the two blocks nodes[:cut] and nodes[cut:], and which of
    them links between the blocks join."""
    import numpy as np

    inside = linked.copy()
    inside[:cut, cut:] = inside[cut:, :cut] = False
    _, label = np.unique(roots_of(inside), return_inverse=True)
    least = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    a, b = np.nonzero(linked[:cut, cut:])
    joined = np.zeros((len(least), len(least)), bool)
    joined[label[a], label[b + cut]] = joined[label[b + cut], label[a]] = True
    return least, joined


def compare_groups(members: DataFrame, compare: Callable, payload: list[str], per_block: int = 128, block_bytes: int = 4 << 20, count: bool = True) -> DataFrame:
    """Compares all members of each group: `members` has grp long, node long, w long (weight), size long
    (bytes) and the payload columns. Returns (grp, node, links, root, blocks), a row for each node and block
    pair: the weight of the nodes it links with there, and the smallest node that links reach there.

    A group of more than `per_block` nodes or `block_bytes` is dealt into blocks by a hash, and each pair
    of blocks is a piece of work of its own, so a task never holds more than two blocks. Only sums and one
    root for each node are written, not pairs. compare(left columns, right columns, same) gives a boolean
    matrix. A node that stands twice in a group counts once.

    Without `count`, links are not counted, and a pair of different blocks only gives how the components
    inside the two blocks hang together: a row for each component of a block, not for each node.
    """
    spark = members.sparkSession
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(per_block)), F.ceil(F.sum("size") / F.lit(block_bytes)))
    rows = sized(members, ["grp"], blocks, "blocks", 1)
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(11), "node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    rows = rows.select("grp", "lo", "hi", "own", "blocks", "node", "w", *payload).repartition(partitions(spark), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "own", "node")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, out = ["grp", "node", "links", "root", "blocks"], [[] for _ in range(5)]
        for (grp, lo, hi), (own, blocks, node, w, *load) in runs_of(batches, ["grp", "lo", "hi"], ["own", "blocks", "node", "w", *payload]):
            keep = [k for k in range(len(node)) if k == 0 or node[k] != node[k - 1]]
            if len(keep) < 2:
                continue
            nodes, weight = np.array([node[k] for k in keep], np.int64), np.array([w[k] for k in keep], np.int64)
            load = [[c[k] for k in keep] for c in load]
            if lo == hi:
                full = np.array(compare(load, load, True))
                np.fill_diagonal(full, False)
            else:
                cut = sum(own[k] == lo for k in keep)
                if cut in (0, len(keep)):
                    continue
                if count:
                    part = compare([c[:cut] for c in load], [c[cut:] for c in load], False)
                    full = np.zeros((len(keep), len(keep)), bool)
                    full[:cut, cut:] = part
                    full[cut:, :cut] = part.T
                else:
                    full = np.array(compare(load, load, True))
                    np.fill_diagonal(full, False)
                    nodes, full = inner_roots(nodes, full, cut)
                    weight = np.zeros(len(nodes), np.int64)
            hit = np.flatnonzero(full.any(axis=1))
            if not len(hit):
                continue
            full = full[np.ix_(hit, hit)]
            nodes, weight = nodes[hit], weight[hit]
            label = roots_of(full)
            least = np.full(len(hit), np.iinfo(np.int64).max)
            np.minimum.at(least, label, nodes)
            for o, x in zip(out, ([grp] * len(hit), nodes.tolist(), (full @ weight).tolist(), least[label].tolist(), [blocks[0]] * len(hit)), strict=True):
                o += x
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)
                out = [[] for _ in range(5)]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)
        release()

    lean(spark)
    return rows.mapInArrow(run, "grp long, node long, links long, root long, blocks long")


def links_and_components(members: DataFrame, compare: Callable, payload: list[str], work: Scratch, per_block: int = 128, block_bytes: int = 4 << 20) -> DataFrame:
    """(node, links, root) of every node that links with another of its group: see compare_groups. Groups of
    several blocks get their components from the roots that the blocks gave."""
    found = work.write(compare_groups(members, compare, payload, per_block, block_bytes), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    far = components(found.where("blocks > 1 AND node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), work, "blocks")
    far = far.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return links.join(far, F.col("node") == F.col("_node"), "left").select("node", "links", F.coalesce("_root", "root").alias("root"))
