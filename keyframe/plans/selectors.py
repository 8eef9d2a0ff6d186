"""Key selectors: `K`, `A..`, `..B`, `A..B`, both ends inclusive; several are united."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SelectorError
from ..functions.keys import order_column, order_lit, order_value, parse_key
from ..types import Field


@dataclass(frozen=True)
class Selector:
    """Keys from low to high; None is open."""

    low: object = None
    high: object = None

    @classmethod
    def parse(cls, field: Field, text: str) -> Selector:
        if ".." not in text:
            k = parse_key(field, text)
            return cls(k, k)
        left, _, right = text.partition("..")
        if not left and not right:
            raise SelectorError("a range needs an end")
        if ".." in right or right.startswith("."):
            raise SelectorError(f"bad selector {text!r}")
        low = parse_key(field, left) if left else None
        high = parse_key(field, right) if right else None
        if left and right and order_value(field, low) > order_value(field, high):
            raise SelectorError(f"reversed range {text!r}")
        return cls(low, high)

    def ordered(self, field: Field) -> tuple:
        return tuple(None if v is None else order_value(field, v) for v in (self.low, self.high))


def parse_all(field: Field, texts: list[str]) -> list[Selector]:
    return [Selector.parse(field, t) for t in texts]


def intervals(field: Field, selectors: list[Selector]) -> list[tuple]:
    """Disjoint key intervals (low, high) in order; reversed ones select nothing."""
    low_of = lambda p: (p[0] is not None, p[0] if p[0] is not None else 0)
    found = sorted((p for s in selectors if None in (p := s.ordered(field)) or p[0] <= p[1]), key=low_of)
    out: list[list] = []
    for low, high in found:
        if out and (out[-1][1] is None or low is None or low <= out[-1][1]):
            if out[-1][1] is not None and (high is None or high > out[-1][1]):
                out[-1][1] = high
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def predicate(field: Field, selectors: list[Selector], column: Column | None = None, lit=None) -> Column:
    """A filter on the key column: one BETWEEN for each disjoint interval, so it reaches the scan. No selector: all.

    lit gives the literal that column is compared with, from a key's order value."""
    c = order_column(field, column) if lit is None else column
    lit = lit or (lambda v: order_lit(field, v))
    if not selectors:
        return F.lit(True)
    tests = []
    for low, high in intervals(field, selectors):
        if low is None or high is None:
            tests.append(F.lit(True) if low is high else c <= lit(high) if low is None else c >= lit(low))
        else:
            tests.append(c == lit(low) if low == high else c.between(lit(low), lit(high)))
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def bounds(df: DataFrame, field: Field, selectors: list[Selector], column: Column | None = None) -> list[tuple[int, int]]:
    """Half-open position ranges of all selectors, by rank counts in one pass over the key column."""
    c = order_column(field, column)
    if not selectors:
        n = df.count()
        return [(0, n)]
    aggs = []
    for i, s in enumerate(selectors):
        low, high = s.ordered(field)
        aggs.append((F.lit(0) if low is None else F.count_if(c < order_lit(field, low))).cast("long").alias(f"s{i}") if low is not None else F.max(F.lit(0)).cast("long").alias(f"s{i}"))
        aggs.append((F.count(F.lit(1)) if high is None else F.count_if(c <= order_lit(field, high))).cast("long").alias(f"e{i}"))
    r = df.agg(*aggs).first()
    return [(r[f"s{i}"] or 0, r[f"e{i}"]) for i in range(len(selectors))]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges; overlapping and touching ones are one, empty ones go."""
    out: list[list[int]] = []
    for s, e in sorted(r for r in ranges if r[0] < r[1]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def resolve(df: DataFrame, field: Field, selectors: list[Selector], column: Column | None = None) -> list[tuple[int, int]]:
    """Position ranges of a selection; no selector on an empty set is the one range (0, 0)."""
    found = bounds(df, field, selectors, column)
    return found if not selectors else merge(found)
