"""Split and concat."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import FrameDataset
from ..errors import IncompatibleError, KeyOrderError
from ..functions.keys import order_lit, order_value
from ..types import richest
from .read import check_sorted
from .strings import merge

PART, SOURCE = "part", "_source"


def part_of(d: FrameDataset, keys: list) -> Column:
    """The number of split keys that are not above the row's key."""
    out = F.lit(0)
    for k in keys:
        out = out + F.when(d.key >= order_lit(d.schema.key, order_value(d.schema.key, k)), 1).otherwise(0)
    return out.cast("long")


def split(d: FrameDataset, keys: list, keep_empty: bool = False) -> DataFrame:
    """Each row with its part; without keep_empty, parts are numbered over those that have rows."""
    if not keys:
        raise KeyOrderError("none", "none", "split needs keys")
    check_sorted(d, keys)
    t = d.df.withColumn(PART, part_of(d, keys))
    if keep_empty:
        return t
    used = t.groupBy(PART).count().select(PART, (F.row_number().over(Window.orderBy(PART)) - 1).cast("long").alias("_n"))
    return t.join(F.broadcast(used), PART).withColumn(PART, F.col("_n")).drop("_n")  # at most len(keys) + 1 rows


def split_counts(d: FrameDataset, keys: list, keep_empty: bool = False) -> DataFrame:
    """Frames of each part, with empty parts if they are kept."""
    n = split(d, keys, keep_empty).groupBy(PART).agg(F.count("*").alias("frame_count"))
    if not keep_empty:
        return n
    every = d.df.sparkSession.range(len(keys) + 1).select(F.col("id").alias(PART))
    return every.join(n, PART, "left").select(PART, F.coalesce("frame_count", F.lit(0)).cast("long").alias("frame_count"))


def parts(d: FrameDataset, keys: list, keep_empty: bool = False) -> list[FrameDataset]:
    """One dataset for each part."""
    check_sorted(d, keys)
    p = part_of(d, keys)
    out = [replace(d.of(d.df.where(p == i)), title=d.title) for i in range(len(keys) + 1)]
    return out if keep_empty else [x for x in out if not x.df.isEmpty()]


def boundaries(sources: list[FrameDataset]) -> DataFrame:
    """First and last key and rows of each source, in order, and whether it starts below what came before."""
    rows = None
    for i, d in enumerate(sources):
        r = d.df.agg(F.lit(i).cast("long").alias("source"), F.count("*").alias("frame_count"), F.min(d.key).alias("first_key"), F.max(d.key).alias("last_key"))
        rows = r if rows is None else rows.unionByName(r)
    reach = F.max("last_key").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("disordered", F.coalesce(F.col("first_key") < reach, F.lit(False)))


def concat(sources: list[FrameDataset], strict: bool = True) -> FrameDataset:
    """The sources end to end: compatible schemas (equal ones, if strict), one title, string tables
    that agree, and keys that do not fall from one source to the next; empty sources are skipped."""
    if not sources:
        raise IncompatibleError("no sources")
    first = sources[0]
    for d in sources[1:]:
        if not d.schema.compatible(first.schema):
            raise IncompatibleError("schemas differ")
        if strict and d.schema != first.schema:
            raise IncompatibleError("semantics differ")
        if d.title != first.title:
            raise IncompatibleError(f"titles differ: {first.title!r} and {d.title!r}")
    strings = merge([d.strings for d in sources])
    last = None
    for r in boundaries(sources).orderBy("source").collect():  # one row per source
        if r.disordered:
            raise KeyOrderError(r.first_key, last, f"source {r.source}")
        last = r.last_key if r.last_key is not None else last
    out, ties = None, (SOURCE, *(t for t in first.of(first.df).ties if t != SOURCE))
    for i, d in enumerate(sources):
        x = d.of(d.df)
        x = x.df.select(*[f"`{n}`" for n in dict.fromkeys([*d.schema.names, *(t for t in x.ties if t != SOURCE)])]).withColumn(SOURCE, F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return replace(first, df=out, schema=richest([d.schema for d in sources]), strings=strings, ties=ties)
