"""Compact query specs over positional columns.

    R=<path> S=<path> join:R4=S2 res:S0,R6,R9
    R=<path> groupby:R8 res:count,avg(R7),max(R6)
    R=<path> select:R6,ge,12.5 distinct:R1,R8

R and S are tables; R<i> and S<i> are their columns from 0. The arguments may come in any order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from millrace.functions import COMPARISONS

USAGE = __doc__.split("\n\n")[1]
#: Aggregates that a spec may name; others can be given to parse.
AGGREGATES = ("count", "avg", "max", "sum", "min")


@dataclass(frozen=True)
class Ref:
    side: str
    index: int

    @classmethod
    def parse(cls, text: str, sides: str = "RS") -> Ref:
        if not (m := re.fullmatch(rf"([{sides}])(\d+)", text)):
            raise ValueError(f"{text!r} is no column; wanted is one of {'|'.join(sides)} and a number\n{USAGE}")
        return cls(m[1], int(m[2]))

    def __str__(self) -> str:
        return f"{self.side}{self.index}"


@dataclass(frozen=True)
class Join:
    r: str
    s: str
    r_key: Ref
    s_key: Ref
    res: tuple[Ref, ...]


@dataclass(frozen=True)
class Aggregate:
    op: str
    of: Ref | None = None

    @property
    def name(self) -> str:
        return self.op if self.of is None else f"{self.op}({self.of})"


@dataclass(frozen=True)
class GroupBy:
    r: str
    key: Ref
    res: tuple[Aggregate, ...]


@dataclass(frozen=True)
class Distinct:
    r: str
    where: Ref
    op: str
    constant: float
    columns: tuple[Ref, ...]


def parse(*args: str, aggregates: Iterable[str] = AGGREGATES) -> Join | GroupBy | Distinct:
    """The query that the arguments (or one string with blanks between them) say; ValueError with the usage
    if they say none. `aggregates` are the names that a group-by may use: count, and others of one column."""
    if len(args) == 1:
        args = tuple(args[0].split())
    given: dict[str, str] = {}
    for a in args:
        if not (m := re.fullmatch(r"(?:([RS])=|(join|res|groupby|select|distinct):)(.+)", a)) or (m[1] or m[2]) in given:
            raise ValueError(f"{a!r} can't be read\n{USAGE}")
        given[m[1] or m[2]] = m[3]
    kinds = set(given)
    if kinds == {"R", "S", "join", "res"}:
        keys = [Ref.parse(x) for x in given["join"].split("=")]
        if sorted(k.side for k in keys) != ["R", "S"]:
            raise ValueError(f"a join needs a column of R and one of S\n{USAGE}")
        r, s = sorted(keys, key=lambda k: k.side)
        return Join(given["R"], given["S"], r, s, tuple(Ref.parse(x) for x in given["res"].split(",")))
    if kinds == {"R", "groupby", "res"}:
        res = []
        for x in given["res"].split(","):
            m = re.fullmatch(r"(count)|(\w+)\((R\d+)\)", x)
            if not m or (m[1] or m[2]) not in aggregates or m[2] == "count":
                known = ", ".join(a if a == "count" else f"{a}(R<i>)" for a in aggregates)
                raise ValueError(f"{x!r} is no aggregate; one of {known}\n{USAGE}")
            res.append(Aggregate(m[1] or m[2], Ref.parse(m[3]) if m[3] else None))
        return GroupBy(given["R"], Ref.parse(given["groupby"], "R"), tuple(res))
    if kinds == {"R", "select", "distinct"}:
        where = given["select"].split(",")
        if len(where) != 3 or where[1] not in COMPARISONS:
            raise ValueError(f"a selection is R<i>,<{'|'.join(COMPARISONS)}>,<number>\n{USAGE}")
        return Distinct(given["R"], Ref.parse(where[0], "R"), where[1], float(where[2]), tuple(Ref.parse(x, "R") for x in given["distinct"].split(",")))
    raise ValueError(USAGE)
