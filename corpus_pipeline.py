"""A training-data pipeline over `documents`, in five stages of the llm subpackage's operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's docs. All but the last return the columns of their docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import BLANKS, Scratch, field, packed, table, unpacked
from millrace.llm.jaccard import jaccard_join
from millrace.llm.language import fit_languages, identify
from millrace.llm.line_dedup import line_dedup
from millrace.llm.mixing import mix_sources
from millrace.llm.pieces import default_model, round_trip

#: A document stays if the language is at least so sure.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose most likely language has a posterior below SURE. The
    languages are learned from the rows of `docs` that have one; if none has, only documents without a letter
    go."""
    model = fit_languages(docs, default_model())
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows, given = packed(docs)
    judged = identify(rows.withColumn("text", F.col(field(docs, "text"))), model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*unpacked(docs, given))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten different texts share stay in one of them and go from the others; n_chars follows the
    text. Copies of one text count as one, so a group of copies reaches the next stage whole, and no line is lost
    from the corpus. No document goes."""
    rows, given = packed(docs)
    kept = line_dedup(rows.select("row", F.col(field(docs, "doc_id")).alias("doc_id"), F.col(field(docs, "text")).alias("text")), keep_one=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(field(docs, c)).alias(c) for c in given])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 0.8 join, the one with the smallest id stays (all rows of that id, if
    it is repeated); of documents without a word, which are copies of nothing, too. Rows without id stay."""
    classes = jaccard_join(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id")).where("doc_id = class_id").distinct()
    rows, given = packed(docs)
    own, text = F.col(field(docs, "doc_id")), F.col(field(docs, "text"))
    blank = F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))) == 0
    first = rows.where(blank).agg(F.min(own).alias("m")).first()["m"]
    kept = rows.join(classes, own == F.col("id"), "left").where(F.col("id").isNotNull() | own.isNull())
    return kept.where(~blank | (own == F.lit(first)) | own.isNull()).select(*unpacked(docs, given))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows, given = packed(docs)
    rows = rows.select("row", *[F.col(field(docs, c)).alias(c) for c in ("doc_id", "text", "source")])
    taken = mix_sources(rows).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*unpacked(docs, given))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and digests of them and of the text that they decode to."""
    rows = round_trip(docs.select("doc_id", "source", "lang", "text"), default_model())
    spaced = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spaced.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("ngram_jaccard_join", near_duplicates), ("mix_sources", mixed), ("sentencepiece", pieces)]

#: Sampled runs, fitted models and merges aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.write(docs, name)
            if k:
                work.drop(STAGES[k - 1][0])
    return docs
