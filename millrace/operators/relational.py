"""Equi-join, group-by and filtered distinct by compact specs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import compare
from millrace.plans.state import SHUFFLE, Tables, cut, parts_for
from millrace.sources import cells_of_groups, cells_of_join, cells_of_rows
from millrace.spec import Distinct, GroupBy, Join, Ref, parse

#: Aggregates by name, for specs too; more can be added. All but count name a column.
AGGREGATES: dict[str, Callable] = {"count": lambda c: F.count("*"), "avg": F.avg, "max": F.max, "sum": F.sum, "min": F.min}


def _side(df: DataFrame, side: str, wanted: list[Ref], order: list[str] = ()) -> DataFrame:
    """The columns asked for, named by their refs; Catalyst prunes the scan to them."""
    cols = dict.fromkeys(r.index for r in wanted if r.side == side)
    return df.select(*[F.col(df.columns[i]).alias(f"{side}{i}") for i in cols], *[F.col(c).alias(f"_{side}_{k}") for k, c in enumerate(order)])


def join(r: DataFrame, s: DataFrame, q: Join, how: str = "hash", r_order: list[str] = (), s_order: list[str] = (), strategy: str | None = None, parts: int | None = None) -> DataFrame:
    """All matches of an inner equi-join: key and the asked columns (R5, S1). `how`, hash or merge, only says
    in which order join_cells counts matches: the bag is the same, and Catalyst chooses how to join by the sizes of
    both sides. `strategy` (broadcast, shuffle_hash or merge, a hint for S) is for callers who know better.
    With `parts`, both sides are dealt by their keys into so many partitions. Keys that are null match nothing."""
    wanted = [q.r_key, q.s_key, *q.res]
    left, right = _side(r, "R", wanted, r_order), _side(s, "S", wanted, s_order)
    if parts:
        left, right = (side.where(F.col(str(k)).isNotNull()).repartition(parts, F.col(str(k))) for side, k in ((left, q.r_key), (right, q.s_key)))
    out = left.join(right.hint(strategy) if strategy else right, F.col(str(q.r_key)) == F.col(str(q.s_key)))
    extra = [c for c in out.columns if c.startswith("_")]
    return out.select(F.col(str(q.r_key)).alias("key"), *dict.fromkeys(str(x) for x in q.res), *extra)


def _placed(df: DataFrame) -> tuple[DataFrame, int]:
    """`df`, whose rows have _file and _line, with the place of its line among those of all files as _place, a number
    where the two would be a path and a number in every row that is sorted; and the number of rows. Files are
    counted first (a row for each), and their counts summed in the files' order."""
    files = df.groupBy(F.col("_file").alias("_f")).agg((F.max("_line") + 1).alias("_lines"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_lines").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = Tables(df.sparkSession, "files").write(files.select("_f", before.alias("_before"), "_rows"), "files")
    count = files.agg(F.sum("_rows")).first()[0] or 0
    return df.join(F.broadcast(files.drop("_rows")), F.col("_file") == F.col("_f")).select(*df.columns, (F.col("_before") + F.col("_line")).alias("_place")), count


def join_cells(r: DataFrame, s: DataFrame, q: Join, how: str = "hash", r_order: list[str] = (), s_order: list[str] = ()) -> DataFrame:
    """The matches as cells: row_key, family, qualifier, value. A key's further matches are told apart by
    their number, in R's order then S's for `merge`, in S's then R's for `hash`; the columns of r_order and
    s_order give that order, or else the lines of the files, if rows have them (_file and _line of with_lines).
    Both sides are counted first: where they have more rows than the session's partitions should sort (TASK_ROWS in each),
    they are dealt into more, which the numbers of matches are then counted in too."""
    sides, total = [], 0
    for df, order in ((r, r_order), (s, s_order)):
        if not order and {"_file", "_line"} <= set(df.columns):
            (df, count), order = _placed(df), ["_place"]
        else:
            count = df.count()
        sides.append((df, order))
        total += count
    (r, r_order), (s, s_order) = sides
    parts = parts_for(r.sparkSession, total)
    matches = join(r, s, q, how, r_order, s_order, parts=parts if parts > int(r.sparkSession.conf.get(SHUFFLE)) else None)
    by = [f"_R_{k}" for k in range(len(r_order))], [f"_S_{k}" for k in range(len(s_order))]
    by = by[0] + by[1] if how == "merge" else by[1] + by[0]
    matches = matches.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*(by or ["key"]))) - 1)
    return cells_of_join(matches, "key", "_n", {str(x): str(x) for x in q.res})


def group_by(r: DataFrame, q: GroupBy, exact: bool = False) -> DataFrame:
    """key and an aggregate per spec name: counts, doubles for avg and max. With `exact`, values are summed as
    decimals of two places, so that the average doesn't depend on the order of rows."""
    value = lambda a: None if a.of is None else F.col(r.columns[a.of.index]).cast("decimal(18,2)" if exact else "double")
    mean = lambda c: F.sum(c).cast("double") / F.count(c)
    aggs = [(mean if exact and a.op == "avg" else AGGREGATES[a.op])(value(a)).cast("long" if a.op == "count" else "double").alias(a.name) for a in q.res]
    return r.groupBy(F.col(r.columns[q.key.index]).alias("key")).agg(*aggs)


def filtered(r: DataFrame, where: Ref, op: str, constant: float) -> DataFrame:
    return r.where(compare(F.col(r.columns[where.index]), op, constant))


def distinct(r: DataFrame, q: Distinct, ranked: bool = False) -> DataFrame:
    """The distinct asked columns (R8, R9) of the rows that pass the selection. With `ranked`, a column rank
    counts them from 0 by their values as text, each followed by |.

    The rank comes from a range-partitioned sort (see ranked_rows), so no task holds all rows.
    """
    cols = {str(x): r.columns[x.index] for x in dict.fromkeys(q.columns)}
    rows = filtered(r, q.where, q.op, q.constant).select(*[F.col(c).alias(n) for n, c in cols.items()]).distinct()
    return ranked_rows(rows, F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in cols], F.lit(""))) if ranked else rows


def ranked_rows(rows: DataFrame, *keys: Column, name: str = "rank") -> DataFrame:
    """`rows` with their place from 0 in the order of `keys` (columns, which may be descending), ties by all columns.

    Rows are dealt into ranges of the order and kept so; ranges are counted and their counts summed in order
    (one row per range), and only within a range are rows numbered.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, *rows.columns]
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    out = dealt.withColumn("_i", own).join(parts, "_p")
    return out.withColumn(name, F.col("_before") + F.col("_i") - 1).drop("_p", "_before", "_i")


def run(spec: str, read: Callable[[str], DataFrame], how: str = "hash", strategy: str | None = None) -> DataFrame:
    """Parses a spec, reads its tables by `read` and runs it; `how` is hash or sort (merge), `strategy` a
    hint for joins."""
    q = parse(spec, aggregates=AGGREGATES)
    if isinstance(q, Join):
        return join(read(q.r), read(q.s), q, "hash" if how == "hash" else "merge", strategy=strategy)
    if isinstance(q, GroupBy):
        return group_by(read(q.r), q, exact=how != "hash")
    return distinct(read(q.r), q, ranked=how != "hash")


def run_cells(spec: str, read: Callable[[str], DataFrame], how: str = "hash", **order) -> DataFrame:
    """The same as cells (row_key, family, qualifier, value), ready for write_table."""
    q = parse(spec, aggregates=AGGREGATES)
    if isinstance(q, Join):
        return join_cells(read(q.r), read(q.s), q, "hash" if how == "hash" else "merge", **order)
    if isinstance(q, GroupBy):
        return cells_of_groups(group_by(read(q.r), q, exact=how != "hash"), "key", {a.name: a.name for a in q.res})
    return cells_of_rows(distinct(read(q.r), q, ranked=True), "rank", {str(x): str(x) for x in dict.fromkeys(q.columns)})
