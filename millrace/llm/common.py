"""What several operators share: the scratch folder, table reading, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.ship import ship
from millrace.plans.state import own_folder

#: The white space of the word and line definitions: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, whatever stands in it: a dot or a tick is part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_ids(df: DataFrame, name: str) -> Column:
    """An id column as long; ValueError if it holds no whole numbers by its type."""
    if (kind := df.schema[name].dataType.typeName()) not in ("byte", "short", "integer", "long", "void"):
        raise ValueError(f"{name} must be a column of whole numbers, not {kind}")
    return column(name).cast("long")


def packed(df: DataFrame, replaced: tuple = ()) -> tuple[DataFrame, list[str]]:
    """(`df` as one struct column `row` of c0, c1, ..., the columns' names): beside it, an operator's own columns
    clash with none of the caller's. See unpacked."""
    fields = [column(c).alias(f"c{i}") for i, c in enumerate(df.columns)] or [F.lit(None).alias("c0")]
    return df.select(F.struct(*fields).alias("row")), [c for c in df.columns if c not in replaced]


def field(df: DataFrame, name: str) -> str:
    """Where the packed row of `df` holds the column of that name."""
    return f"row.c{df.columns.index(name)}"


def unpacked(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns `names` of the frame `df` that was packed, from its rows, under their own names."""
    return [F.col(field(df, c)).alias(c) for c in names]


def numbered(df: DataFrame, given: list[str], text_col: str) -> tuple[DataFrame, list[str]]:
    """(the columns `given` of `df` as c0, c1, ... and `text_col` as text, the former names): names that Arrow
    functions can take."""
    names = [f"c{i}" for i in range(len(given))]
    return df.select(*[column(c).alias(n) for c, n in zip(given, names, strict=True)], column(text_col).alias("text")), names


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a folder of our own on a local master
    (tests), and an error on another, whose machines would not share it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = spark.conf.get("spark.millrace.scratch", None)
    if not own:
        own = f"file://{own_folder(spark.sparkContext)}"
        spark.conf.set("spark.millrace.scratch", own)
    return own


def lean(spark: SparkSession) -> None:
    """Before Python runs on the executors: sends them this package, and lets Arrow batches hold fewer rows,
    if their size is the default one: whole texts pass through them, and the JVM and Python each hold a batch
    beside their own work."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


_held: dict = {}


def once(key, make):
    """What make() returns, kept in this worker until another key comes: a worker serves many tasks, and
    holds one model at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Drops what once() keeps, before work that needs none of it: workers go on to the next operator."""
    _held.clear()


def release(cycles: bool = True) -> None:
    """Gives free memory back at the end of a task, since workers stay; without looking for `cycles`, a
    cheaper step between groups."""
    import ctypes
    import gc

    import pyarrow as pa

    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Deletes the shuffle files of a query at its end. Set while a table is written, since nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of `df` from a table; its shuffle files are deleted once that is written."""
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, once nothing lazy reads them any more."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(root):
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of the undirected links (a long, b long): one row (node, root) for each
    linked node, root being the smallest node that links reach.

    Alternates large-star and small-star steps until the links are stars. Every step is a min per node
    (summed before the shuffle) and an equi-join back, and is written to the scratch folder; links stay
    distributed, and a hub's links are split by the skew join.
    """
    e = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1000003).alias("s")).first()
        if now["n"] == 0 or mark == tuple(now):
            break
        mark, step = tuple(now), step + 1
        # Large star: each node's larger neighbours go to the smallest of its neighbours and itself.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        e = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        low = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = e.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = scratch.write(moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
