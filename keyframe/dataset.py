"""FrameDataset: a DataFrame with the header of an ordered record set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import SchemaError
from .functions.keys import order_column, order_lit
from .plans.ordering import INDEX, with_index
from .types import Schema


#: Former positions, which order rows of equal keys.
ARRIVAL = "_arrival"


@dataclass(frozen=True)
class StoredKey:
    """The column that a key is computed from, and the key's values as literals of its type.

    The two must order alike.  Filters on it reach the scan, which filters on an expression do not.
    """

    column: str
    literal: Callable[[int], Column]


@dataclass(frozen=True)
class FrameDataset:
    """df has the schema's columns (and `_frame_index` once numbered); ties are the columns
    that order rows of equal keys, in place of arrival order.  A projected dataset has only some of
    the schema's columns.  stored is set where df is a projection of rows that hold that column."""

    df: DataFrame
    schema: Schema
    title: str = "untitled"
    strings: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()
    stored: StoredKey | None = None
    projected: bool = False

    def __post_init__(self) -> None:
        if not self.title:
            raise SchemaError("empty title")
        if not self.projected and (missing := [n for n in self.schema.names if n not in self.df.columns]):
            raise SchemaError(f"column {missing[0]!r} is missing")

    @property
    def key(self) -> Column:
        return order_column(self.schema.key)

    @property
    def order(self) -> list[Column]:
        return [self.key, *(F.col(f"`{t}`") for t in self.ties)]

    def test(self, compare: Callable[[Column, Callable[[object], Column]], Column]) -> Column:
        """A filter for df from compare(key, literal of a key's order value), on the stored column if there is one."""
        if self.stored is not None:
            return compare(F.col(f"`{self.stored.column}`"), self.stored.literal)
        return compare(self.key, lambda v: order_lit(self.schema.key, v))

    def numbered(self) -> FrameDataset:
        """With global positions; only operators that need them all pay for this."""
        return self if INDEX in self.df.columns else replace(self, df=with_index(self.df, self.order), stored=None)

    def frames(self) -> DataFrame:
        return self.df.select(*[f"`{n}`" for n in self.schema.names if not self.projected or n in self.df.columns])

    def of(self, df: DataFrame) -> FrameDataset:
        """The same header over other rows; positions are dropped, since they may have changed, but still order
        rows of equal keys where they did."""
        if INDEX in self.ties and INDEX in df.columns:
            df = df.withColumnRenamed(INDEX, ARRIVAL)
        ties = (ARRIVAL if t == INDEX else t for t in self.ties)
        df = df.drop(INDEX)
        return replace(self, df=df, stored=None, ties=tuple(t for t in ties if t in df.columns))
