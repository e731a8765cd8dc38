"""Where the lines of files stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.state import Tables

#: Splits of files whose places are sent to all executors; more meet the lines in a shuffle.
SPLITS = 1_000_000
#: Spark cuts files by their sizes and this number, or else by the cores it has just then.
CUT = "spark.sql.files.minPartitionNum"


def with_lines(df: DataFrame) -> DataFrame:
    """`df` with _file and _line: the file that a row was read from, and its number there, from 0. `df` is what a
    reader of lines gave (text, or delimited lines; nothing filtered yet): a line that the reader skips, as blank ones
    of delimited files, has no number.

    Files are read in splits, by as many tasks. A row's place in its split comes from the row number that Spark gives
    within a task; splits are counted first, and their counts summed in the order of their first byte (a row for each
    split). So no line moves and none is sorted; files are read twice. The number of parts that files are cut into
    is held for the session, if it isn't set, so that both times they are cut alike."""
    spark = df.sparkSession
    _hold_cuts(spark)
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy(F.col("_file").alias("_f"), F.col("_split").alias("_s")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    splits = splits.select("_f", "_s", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    splits = Tables(spark, "splits").write(splits, "splits")
    if splits.count() <= SPLITS:
        splits = F.broadcast(splits)
    placed = rows.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    return placed.select(*df.columns, "_file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("_line"))


def _hold_cuts(spark: SparkSession) -> None:
    if spark.conf.get(CUT, None) is None:
        spark.conf.set(CUT, str(spark.sparkContext.defaultParallelism))
