"""Word counts and pair statistics that follow a folder of text files, by the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.textagg import pair_stats, word_count
from millrace.sources import read_keyed


def stream_lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)


def stream_word_count(lines: DataFrame) -> DataFrame:
    return word_count(lines)


def stream_pair_stats(lines: DataFrame) -> DataFrame:
    return pair_stats(read_keyed(lines))


def start(aggregate: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the whole result in a table in memory, as of the last batch; `checkpoint` holds its state."""
    return aggregate.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
