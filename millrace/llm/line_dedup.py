"""Line dedup: lines that many documents share are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLANKS, ascii_lower, field, packed, table

#: Parts into which the rows of one hash are dealt for the join.
SALTS = 16


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_one: bool = False) -> DataFrame:
    """Drops, in every document, the lines whose key at least `min_docs` documents hold.

    With `keep_one`, nothing is lost from the table as a whole: documents of one text count as one, and of
    the texts that hold a hot line, the one with the smallest hash keeps it, in all its copies, as often as it has it.

    Lines end at \\n; a line's key is the line without blanks at both ends, with A-Z lower-cased; keys of
    fewer than `min_chars` code points are never dropped. Returns the rows of `docs` with `text_col`
    replaced by the kept lines joined by \\n, and n_lines, n_dropped (which replace columns so named).

    Lines are exploded to (document, position, 128-bit hash of the key); a hash's documents are counted
    distinct, in two steps that sum before each shuffle; the positions of hot hashes are gathered per
    document, and each document is put together again from the slices between them. Lines themselves are
    never shuffled, and a document's text moves once. A hash that a third of all rows hold is a row for each
    of SALTS parts of the rows, which the skew join splits further where they are still large.

    Null text counts as empty: one empty line, which stays. Null ids count as one document. Rows that
    repeat an id count once for a key; each repeated row is kept and handled alike. If every line goes,
    the text is empty. An empty table gives an empty table; extra columns pass through.
    """
    rows, given = packed(docs, ("n_lines", "n_dropped"))
    text = F.coalesce(F.col(field(docs, text_col)), F.lit(""))
    own = [F.col(field(docs, id_col)).alias("_ld_id"), F.xxhash64(text).alias("_ld_th")]
    key = ascii_lower(F.btrim(F.col("_ld_line"), F.lit(BLANKS)))
    lines = rows.select(*own, F.posexplode(F.split(text, "\n")).alias("_ld_pos", "_ld_line")).select("_ld_id", "_ld_th", "_ld_pos", key.alias("_ld_key"))
    lines = lines.where(F.length("_ld_key") >= min_chars).select("_ld_id", "_ld_th", "_ld_pos", F.xxhash64("_ld_key").alias("_ld_h"), F.xxhash64(F.lit(1), "_ld_key").alias("_ld_g"))
    unit = F.col("_ld_th") if keep_one else F.struct("_ld_id")
    owner = F.min("_ld_th") if keep_one else F.lit(None).cast("long")
    hot = lines.groupBy("_ld_h", "_ld_g").agg(F.count_distinct(unit).alias("_ld_n"), owner.alias("_ld_owner")).where(F.col("_ld_n") >= min_docs).select("_ld_h", "_ld_g", "_ld_owner")
    hot = hot.withColumn("_ld_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("_ld_s", F.pmod(F.xxhash64("_ld_th", "_ld_pos"), F.lit(SALTS)).cast("int"))
    match = salted.join(hot, ["_ld_h", "_ld_g", "_ld_s"]).where(~F.col("_ld_th").eqNullSafe(F.col("_ld_owner"))) if keep_one else salted.join(hot, ["_ld_h", "_ld_g", "_ld_s"], "left_semi")
    drops = match.groupBy("_ld_id", "_ld_th").agg(F.sort_array(F.collect_set("_ld_pos")).alias("_ld_drop"))
    drops = drops.select(F.col("_ld_id").alias("_ld_id2"), F.col("_ld_th").alias("_ld_th2"), "_ld_drop")
    rows = rows.select("row", *own).join(drops, F.col("_ld_id").eqNullSafe(F.col("_ld_id2")) & (F.col("_ld_th") == F.col("_ld_th2")), "left")
    # A one-element array binds the split lines and the cuts, so that they are computed once for a document.
    bound = F.array(F.struct(F.split(text, "\n").alias("l"), F.concat(F.array(F.lit(-1)), F.col("_ld_drop"), F.array(F.size(F.split(text, "\n")))).alias("p")))
    kept = F.transform(bound, lambda d: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(d["p"]) - 2), lambda i: F.slice(d["l"], F.get(d["p"], i) + 2, F.get(d["p"], i + 1) - F.get(d["p"], i) - 1))), "\n"))
    n_lines = F.size(F.split(text, "\n")).cast("long")
    out = [F.when(F.col("_ld_drop").isNull(), text).otherwise(F.get(kept, F.lit(0))).alias(c) if c == text_col else F.col(field(docs, c)).alias(c) for c in given]
    return rows.select(*out, n_lines.alias("n_lines"), F.coalesce(F.size("_ld_drop").cast("long") + F.when(F.col("_ld_drop").isNull(), None).otherwise(0), F.lit(0)).cast("long").alias("n_dropped"))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {
    "op2_line_dedup": """
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'null')) >= 10),
    m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
    SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY rid"""
}
