"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or sums, about: shuffles of more rows than the session's partitions take so get more of them.
TASK_ROWS = 1_000_000
#: The session's number of partitions that shuffles make.
SHUFFLE = "spark.sql.shuffle.partitions"
#: Whether small ones are put together.
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


def parts_for(spark: SparkSession, rows: int, least: int | None = None) -> int:
    """Partitions for a shuffle of so many rows: `least` (the session's number), and more for TASK_ROWS in each, so that
    a task's memory doesn't grow with the table."""
    return max(int(spark.conf.get(SHUFFLE)) if least is None else least, -(-rows // TASK_ROWS))


@contextmanager
def shuffled_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside shuffles into parts_for(rows) partitions; where these are more than the session's, they aren't
    put together again. The session's settings hold again afterwards."""
    before, parts = {c: spark.conf.get(c) for c in (SHUFFLE, COALESCE)}, parts_for(spark, rows)
    if parts > int(before[SHUFFLE]):
        spark.conf.set(SHUFFLE, str(parts))
        spark.conf.set(COALESCE, "false")
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def own_folder(context: SparkContext) -> str:
    """A folder of this machine, for local masters only: the machines of a cluster would not share it."""
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="millrace-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or in one of our own on a local master."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{given.rstrip('/') if given else 'file://' + own_folder(spark.sparkContext)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, cached: bool = False) -> DataFrame:
    """The same rows from a checkpoint in the shared folder of spark.checkpoint.dir, so that a lost executor
    costs no earlier step; where that is unset (tests), in a folder of our own. The rows are cached meanwhile,
    unless they are `cached` already, since Spark computes them once more to write them."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(own_folder(context))
    if cached:
        return df.checkpoint(eager=True)
    held = df.persist()
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


class Tables:
    """Tables of one run in the shared folder, which cut lineage and outlive a lost executor. Unlike a checkpoint,
    one can be dropped when it is used up, and read in parts by the columns it was written `by`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
