"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import field, packed, table, unpacked


def words_of(text: Column) -> Column:
    """The number of runs of characters other than [\\x20\\x09-\\x0D]; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Targets for (_mx_src, source_size): each source's share of all sizes by its weight, at most
    `max_repeat` times its size, the excess shared again by weight until no target is above.

    That is a water level: with sources by size / weight, the level where the uncapped ones take what the
    capped ones leave. One row per source stands here, so the windows over all of them hold no documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy("_mx_src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_w", w).withColumn("_cap", F.lit(float(max_repeat)) * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_mx_src")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_wleft", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).withColumn("_i", F.row_number().over(by))
    s = s.withColumn("_t", F.col("_left") / F.col("_wleft"))
    level = F.min_by("_t", F.when(F.col("_t") * F.col("_w") <= F.col("_cap"), F.col("_i"))).over(every)
    return s.withColumn("_level", level).select("_mx_src", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), max_repeat: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Says how often the mix takes each document: `docs` with size (words), source_size, target, copies
    and taken = copies * size (these replace columns so named).

    Within a source the documents stand by size, then by a hash of id and seed. A document is expected
    target / source_size times, so the expected copies before the i-th document are i times that; with one
    random offset for the source, it is taken once for each integer boundary that its stretch crosses.
    Standing by size keeps the words taken within about one document's size of the target; nobody is
    taken more than `max_repeat` times.

    The position comes from three prefix sums (sizes of the source; hash bins of the size; documents of
    the bin), so no task holds a source: only counts per (source, size, bin) are summed beforehand, and
    documents move once, to their bin.

    Null text has size 0. Null sources are a source of their own, ordered last; null ids sort by the hash
    of an empty id. Repeated rows are separate documents. A source without words has target 0 and nothing
    taken. An empty table gives an empty table.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    whole, given = packed(docs, made)
    id_, text, source = (F.col(field(docs, c)) for c in (id_col, text_col, source_col))
    src = F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))
    h = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    rows = whole.select("row", src.alias("_mx_src"), words_of(text).alias("size"), h.alias("_mx_h"), F.xxhash64(text).alias("_mx_t")).withColumn("_mx_bin", F.substring("_mx_h", 1, 3))
    cells = rows.groupBy("_mx_src", "size", "_mx_bin").agg(F.count("*").alias("_n"))
    sizes = cells.groupBy("_mx_src", "size").agg(F.sum("_n").alias("_m"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sizes.groupBy("_mx_src").agg(F.sum(F.col("size") * F.col("_m")).alias("source_size")), weights, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat("_mx_src", F.lit(f":{seed}:offset")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    targets = targets.withColumn("_rate", rate).withColumn("_u", offset)
    sizes = sizes.withColumn("_p", F.coalesce(F.sum("_m").over(before(Window.partitionBy("_mx_src").orderBy("size"))), F.lit(0))).drop("_m").join(targets, "_mx_src")
    cells = cells.withColumn("_q", F.coalesce(F.sum("_n").over(before(Window.partitionBy("_mx_src", "size").orderBy("_mx_bin"))), F.lit(0))).drop("_n").join(sizes, ["_mx_src", "size"])
    own = F.row_number().over(Window.partitionBy("_mx_src", "size", "_mx_bin").orderBy("_mx_h", id_, "_mx_t"))
    out = rows.withColumn("_i", own).join(cells, ["_mx_src", "size", "_mx_bin"])
    rank = F.col("_p") + F.col("_q") + F.col("_i")
    copies = (F.floor(rank * F.col("_rate") + F.col("_u")) - F.floor((rank - 1) * F.col("_rate") + F.col("_u"))).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*unpacked(docs, given), *made)


def op3_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = docs.select("doc_id", "source", "text")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mix_sources": op3_mix_sources}
SQL = {
    "op3_mix_sources": r"""
    WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                      md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS h FROM documents),
    s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM s),
    l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS wrest, row_number() OVER (ORDER BY cap / w, src) AS i
          FROM w WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lev AS (SELECT arg_min(rest / wrest, i) AS level FROM l WHERE rest / wrest * w <= cap),
    t AS (SELECT src, source_size, least(cap, coalesce(level * w, cap)) AS target, ('0x' || substr(md5(src || ':mix:offset'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l, lev),
    r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
                 row_number() OVER (PARTITION BY d.src ORDER BY size, h, doc_id) AS i FROM d JOIN t ON d.src = t.src)
    SELECT doc_id, size, source_size, target, ((floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT * size)::BIGINT AS taken FROM r"""
}
