"""Scalar functions that the operators need, all built from Spark's own."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"gt": operator.gt, "ge": operator.ge, "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le}


def compare(c: Column, op: str, constant: float) -> Column:
    """`c op constant` in 32-bit floats, for a numeric column."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}; one of {', '.join(COMPARISONS)}")
    value = float(constant)
    exact = COMPARISONS[op](c.cast("float"), F.lit(value).cast("float"))
    # Rounding to float keeps the order, so a slightly wider native bound is implied, and the scan can use it.
    slack = max(abs(value), 1e-30) * 1e-6
    if op in ("gt", "ge", "eq"):
        exact &= c >= F.lit(value - slack)
    if op in ("lt", "le", "eq"):
        exact &= c <= F.lit(value + slack)
    return exact


def number(c: Column) -> Column:
    """A double; null where the text is no number."""
    return c.try_cast("double")


def fields(line: Column) -> Column:
    """A |-separated line's fields, without trailing empty ones."""
    return F.split(F.regexp_replace(line, r"\|+$", ""), r"\|")


def tokens(text: Column) -> Column:
    """Words between blanks, tabs, line ends and form feeds."""
    return F.filter(F.split(text, "[ \t\n\r\f]+"), lambda w: w != "")


def decimal_format(c: Column, places: int) -> Column:
    """`places` decimals, half to even, no leading zero and no grouping: .50, 12.30."""
    return F.call_function("format_number", c, F.lit("#." + "0" * places))


def six_places(c: Column) -> Column:
    """Six decimals as C's %f gives them: by the double's exact value, half to even. Java's %f rounds the shortest
    decimal text of the double, half up, which is another number where that text ends in a tie."""
    return F.call_function("format_number", c, F.lit("0.000000"))


def uniform_draw(n: Column, *key: Column) -> Column:
    """A whole number from 0 to n - 1 by a digest of the key, the same whenever a task runs again; null if n
    is null or 0. The first 48 bits of the MD5 of the key's parts with : between them, modulo n."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]).cast("binary"))
    return F.when(n > 0, F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n))
