"""Aggregations over text lines and keyed triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import decimal_format, tokens


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """word, n: case-sensitive words between blanks, tabs, line ends and form feeds."""
    return lines.select(F.explode(tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_lines(counts: DataFrame) -> DataFrame:
    return counts.select("word", F.format_string("count of %s =\t%d", "word", "n").alias("value"))


def pair_stats(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """source, destination, n and the average time as text with three decimals, from source, destination,
    time; `ordered` by source, then destination, as files of a sorted job are (not on a stream)."""
    out = rows.groupBy("source", "destination").agg(F.count("*").alias("n"), decimal_format(F.sum("time").cast("double") / F.count("time"), 3).alias("avg"))
    return out.orderBy("source", "destination") if ordered else out
