"""Deletes, gated appends and header edits; each returns a new dataset (and what it removed)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import FrameDataset
from ..errors import KeyOrderError, RangeError
from ..functions.keys import order_value
from ..plans.ordering import INDEX, violations, with_index
from ..plans.selectors import parse_all
from ..types import Schema
from .read import SMALL_LIST, interval_of, key_in, selection

Removed = tuple[FrameDataset, int]


def _without(d: FrameDataset, gone: Column) -> Removed:
    """By a filter on keys; one count of what it takes."""
    return d.of(d.df.where(~gone)), d.df.where(gone).count()


def _at(d: FrameDataset, start: int, end: int, n: int, keep: Callable[[DataFrame], DataFrame]) -> FrameDataset:
    """What keep leaves of the frames, which may take some at positions start..end only: the others are neither sorted nor numbered."""
    if INDEX in d.df.columns:
        return d.of(keep(d.df))
    if start >= end:
        return d.of(d.df)
    low, high, before, size = interval_of(d, start, end, n)
    inside = [F.lit(True)] if low is None else [d.test(lambda k, lit: k >= lit(low))]
    inside = reduce(Column.__and__, inside + ([] if high is None else [d.test(lambda k, lit: k < lit(high))]))
    found = with_index(d.df.where(inside), d.order, size).withColumn(INDEX, F.col(INDEX) + before)
    kept = keep(found).select(d.df.columns)
    return d.of(kept if size == n else d.df.where(~inside).unionByName(kept))


def delete_frame(d: FrameDataset, index: int) -> tuple[FrameDataset, bool]:
    """False if there is no such position."""
    n = d.df.count()
    if not 0 <= index < n:
        return d.of(d.df), False
    return _at(d, index, index + 1, n, lambda t: t.where(F.col(INDEX) != index)), True


def delete_slice(d: FrameDataset, start: int, end: int) -> Removed:
    n = d.df.count()
    if not 0 <= start <= end <= n:
        raise RangeError(f"frames {start}..{end} of {n}")
    return _at(d, start, end, n, lambda t: t.where(~((F.col(INDEX) >= start) & (F.col(INDEX) < end)))), end - start


def delete_indices(d: FrameDataset, indices: list[int]) -> Removed:
    """Positions in strictly ascending order."""
    n = d.df.count()
    if any(b <= a for a, b in zip(indices, indices[1:], strict=False)) or any(not 0 <= i < n for i in indices):
        raise RangeError("indices must ascend and lie inside the set")
    if not indices:
        return d.of(d.df), 0
    listed = d.df.sparkSession.createDataFrame([(i,) for i in indices], f"{INDEX} long") if len(indices) > SMALL_LIST else None
    keep = (lambda t: t.where(~F.col(INDEX).isin(indices))) if listed is None else (lambda t: t.join(listed, INDEX, "left_anti"))
    return _at(d, indices[0], indices[-1] + 1, n, keep), len(indices)


def delete_ranges(d: FrameDataset, ranges: list[tuple[int, int]]) -> Removed:
    """Half-open, ordered, disjoint ranges inside the set; all are checked before any row goes."""
    n, last = d.df.count(), 0
    for s, e in ranges:
        if not last <= s <= e <= n:
            raise RangeError(f"range {s}..{e} overlaps or lies outside {n} frames")
        last = e
    ranges = [(s, e) for s, e in ranges if s < e]
    if not ranges:
        return d.of(d.df), 0
    gone = reduce(Column.__or__, [(F.col(INDEX) >= s) & (F.col(INDEX) < e) for s, e in ranges])
    return _at(d, ranges[0][0], ranges[-1][1], n, lambda t: t.where(~gone)), sum(e - s for s, e in ranges)


def delete_key(d: FrameDataset, value) -> Removed:
    return _without(d, d.test(lambda k, lit: k == lit(order_value(d.schema.key, value))))


def delete_keys(d: FrameDataset, keys: list) -> Removed:
    """Keys of a sorted list; repeats count once."""
    return d.of(key_in(d, keys, "left_anti")), key_in(d, keys, "left_semi").count()


def delete_key_range(d: FrameDataset, low, high) -> Removed:
    """Both ends included; a reversed range removes nothing."""
    a, b = order_value(d.schema.key, low), order_value(d.schema.key, high)
    return _without(d, d.test(lambda k, lit: k.between(lit(a), lit(b))) if a <= b else F.lit(False))


def delete_before(d: FrameDataset, high) -> Removed:
    return _without(d, d.test(lambda k, lit: k <= lit(order_value(d.schema.key, high))))


def delete_after(d: FrameDataset, low) -> Removed:
    return _without(d, d.test(lambda k, lit: k >= lit(order_value(d.schema.key, low))))


def delete_all(d: FrameDataset) -> Removed:
    return d.of(d.df.limit(0)), d.df.count()


def remove(d: FrameDataset, selectors: list[str], confirm: bool = False) -> Removed:
    """The union of selectors; without any, everything, which needs confirm."""
    if not selectors and not confirm:
        raise RangeError("removing everything needs confirm=True")
    return _without(d, selection(d, parse_all(d.schema.key, selectors)))


# ---------------------------------------------------------------------------- appends


def order_violations(d: FrameDataset, batch: DataFrame, seq: str) -> DataFrame:
    """Rows of batch, in the order of seq, whose key is below the one before."""
    return violations(batch, d.key, seq)


def last_key(d: FrameDataset):
    return d.df.agg(F.max(d.key)).first()[0]


def _boundary(d: FrameDataset, first) -> None:
    last = last_key(d)
    if last is not None and first is not None and first < last:
        raise KeyOrderError(first, last, "append")


def append_presorted(d: FrameDataset, batch: DataFrame, seq: str) -> FrameDataset:
    """Only the first key is checked against the last one stored; the rest is trusted."""
    _boundary(d, batch.agg(F.min_by(d.key, seq)).first()[0])
    return d.of(d.frames().unionByName(batch.select(*d.schema.names)))


def append_transactional(d: FrameDataset, batch: DataFrame, seq: str) -> FrameDataset:
    """Nothing is appended unless the whole batch is in order and not below the last key."""
    bad = order_violations(d, batch, seq).orderBy(seq).select(d.key.alias("k"), "previous_key").first()
    if bad:
        raise KeyOrderError(bad.k, bad.previous_key, "batch")
    return append_presorted(d, batch, seq)


append_frames = append_transactional

# ---------------------------------------------------------------------------- header edits


def set_title(d: FrameDataset, title: str) -> FrameDataset:
    return replace(d, title=title)


def set_frame_type(d: FrameDataset, frame_type: str) -> FrameDataset:
    return replace(d, schema=replace(d.schema, frame_type=frame_type))


def rename(d: FrameDataset, names: dict[str, str]) -> FrameDataset:
    """Columns by other names; a missing or repeated name is an error before anything changes."""
    schema: Schema = d.schema.renamed(names)
    return replace(d, schema=schema, df=d.df.withColumnsRenamed(names), ties=tuple(names.get(t, t) for t in d.ties))


def set_semantics(d: FrameDataset, found: dict[str, str]) -> FrameDataset:
    schema = d.schema.with_semantics(found)
    df = d.df
    for f in schema.spark_schema().fields:
        if f.name in found:
            df = df.withMetadata(f.name, f.metadata)
    return replace(d, schema=schema, df=df)
