"""Predicates that compile to an exact filter and to a rule on row-group statistics.

A rule keeps a group unless its statistics prove that no row passes; missing statistics keep it.
Comparisons are typed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("is_null", "is_not_null", "eq", "ne", "gt", "lt", "between", "in")


@dataclass(frozen=True)
class Pred:
    column: str
    op: str
    values: tuple = ()

    def __post_init__(self) -> None:
        count = {"is_null": 0, "is_not_null": 0, "between": 2}.get(self.op, 1)
        if self.op not in OPS or self.op != "in" and len(self.values) != count:
            raise ValueError(f"{self.op} with {len(self.values)} values")

    def to_filter(self) -> Column:
        c, v = F.col(self.column), [F.lit(x) for x in self.values]
        match self.op:
            case "is_null":
                return c.isNull()
            case "is_not_null":
                return c.isNotNull()
            case "eq":
                return c == v[0]
            case "ne":
                return c != v[0]
            case "gt":
                return c > v[0]
            case "lt":
                return c < v[0]
            case "between":
                return c.between(v[0], v[1])
        return c.isin(*self.values) if self.values else F.lit(False)

    def to_prune(self) -> Column:
        """True where a group of the wide statistics may hold a row that passes."""
        low, high = F.col(f"{self.column}__min"), F.col(f"{self.column}__max")
        nulls, values = F.col(f"{self.column}__null_count"), F.col(f"{self.column}__value_count")
        v = [F.lit(x) for x in self.values]
        match self.op:
            case "is_null":
                keep = nulls > 0
            case "is_not_null":
                keep = values > 0
            case "eq":
                keep = (low <= v[0]) & (v[0] <= high)
            case "ne":
                keep = ~((low == v[0]) & (high == v[0]))
            case "gt":
                keep = high > v[0]
            case "lt":
                keep = low < v[0]
            case "between":
                keep = (high >= v[0]) & (low <= v[1])
            case _:
                keep = reduce(lambda a, b: a | b, [(low <= x) & (x <= high) for x in v], F.lit(False))
        # a group without values has no minimum: only is_null can pass there
        if self.op not in ("is_null", "is_not_null"):
            keep = F.when(values == 0, F.lit(False)).otherwise(keep)
        return F.coalesce(keep, F.lit(True))


def both(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def to_filter(preds: list[Pred]) -> Column:
    return both([p.to_filter() for p in preds])


def to_prune(preds: list[Pred], known: list[str] | None = None) -> Column:
    """The conjunction; predicates on columns without statistics don't prune."""
    own = [p for p in preds if known is None or f"{p.column}__min" in known]
    return both([p.to_prune() for p in own])
