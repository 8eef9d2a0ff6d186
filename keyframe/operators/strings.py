"""String tables: a small ordered list, referred to by position."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import FrameDataset
from ..errors import StringTableError

#: Strings that one table may hold; what is joined as a table is therefore bounded.
MAX_STRINGS = 2048


def as_table(spark: SparkSession, strings: tuple[str, ...] | list[str]) -> DataFrame:
    if len(strings) > MAX_STRINGS:
        raise StringTableError(f"more than {MAX_STRINGS} strings")
    return spark.createDataFrame(list(enumerate(strings)), "idx long, value string")


def build(df: DataFrame, column: str) -> DataFrame:
    """A table (idx, value) of a column's distinct values in their order."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return values.select((F.row_number().over(Window.orderBy("value")) - 1).cast("long").alias("idx"), "value")


def encode(df: DataFrame, table: DataFrame, column: str, out: str) -> DataFrame:
    """Add each value's position; the last of repeated values wins."""
    t = table.groupBy("value").agg(F.max("idx").alias(out))
    return df.join(t, df[column] == t["value"], "left").drop(t["value"])


def decode(df: DataFrame, table: DataFrame, column: str, out: str) -> DataFrame:
    """Add the string at each position; a position outside the table is an error."""
    t = table.select(F.col("idx").alias("_idx"), F.col("value").alias(out))
    found = df.join(t, F.col(column) == F.col("_idx"), "left")
    missing: Column = F.col(column).isNotNull() & F.col("_idx").isNull()
    value = F.when(missing, F.raise_error(F.concat(F.lit("no string at index "), F.col(column).cast("string")))).otherwise(F.col(out))
    return found.withColumn(out, value).drop("_idx")


def reverse(table: DataFrame) -> DataFrame:
    """value -> position, the last of repeated values."""
    return table.groupBy("value").agg(F.max("idx").alias("idx"))


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions that both tables fill with different strings."""
    return a.select("idx", F.col("value").alias("left_value")).join(b.select("idx", F.col("value").alias("right_value")), "idx").where("left_value <> right_value")


def merge(tables: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The longest table, if all agree where they overlap."""
    best = max(tables, key=len, default=())
    for t in tables:
        if tuple(best[: len(t)]) != tuple(t):
            raise StringTableError("string tables disagree")
    return tuple(best)


def append_string(d: FrameDataset, value: str) -> tuple[FrameDataset, int]:
    return replace(d, strings=(*d.strings, value)), len(d.strings)


def replace_strings(d: FrameDataset, values: list[str]) -> FrameDataset:
    return replace(d, strings=tuple(values))


def clear_strings(d: FrameDataset) -> FrameDataset:
    return replace(d, strings=())


def index_of(d: FrameDataset, value: str) -> int | None:
    """The last position of value."""
    return next((i for i in range(len(d.strings) - 1, -1, -1) if d.strings[i] == value), None)
