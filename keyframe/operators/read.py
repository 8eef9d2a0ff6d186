"""Positions, ranges and key reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import FrameDataset
from ..errors import KeyOrderError, RangeError
from ..functions.keys import key_of_order, order_column, order_lit, order_value
from ..plans import ordering
from ..plans.ordering import INDEX, with_index
from ..plans.selectors import Selector, bounds, intervals, merge, parse_all, predicate, resolve

PREVIEW, SPLITS = 3, 64
SMALL_LIST = 1000


def frame_count(d: FrameDataset) -> int:
    return d.df.count()


def _interval_test(d: FrameDataset, low, high) -> Column:
    """Keys from low up to but without high, as order values; None is open."""
    tests = [F.lit(True)] if low is None else [d.test(lambda k, lit: k >= lit(low))]
    tests += [] if high is None else [d.test(lambda k, lit: k < lit(high))]
    return reduce(Column.__and__, tests)


def interval_of(d: FrameDataset, start: int, end: int, n: int) -> tuple[object, object, int, int]:
    """A key interval (low, high) that holds the positions start..end of n: with how many rows before it and in it.

    Each round splits the interval at quantiles of its keys and counts what lies below each, so
    the rows in it are soon few enough to be sorted by themselves; no other row is.
    """
    low, high, before, size = None, None, 0, n
    f = d.schema.key
    key = F.col(f"`{f.name}`")
    while size > ordering.WINDOW_ROWS and isinstance(d.df.schema[f.name].dataType, T.NumericType):
        rows = d.df.where(_interval_test(d, low, high))
        found = rows.agg(F.percentile_approx(key, [i / SPLITS for i in range(SPLITS + 1)], 10_000)).first()[0] or []
        cuts = sorted({order_value(f, v) for v in found if v == v})
        cuts = [v for v in cuts if (low is None or v > low) and (high is None or v < high)]
        if not cuts:
            break
        below = [before + c for c in rows.agg(*[F.count_if(d.key < order_lit(f, v)) for v in cuts]).first()]
        left = max((i for i, c in enumerate(below) if c <= start), default=None)
        right = min((i for i, c in enumerate(below) if c >= end), default=None)
        if left is None and right is None:
            break
        top = before + size if right is None else below[right]
        if left is not None:
            low, before = cuts[left], below[left]
        high = high if right is None else cuts[right]
        size = top - before
    return low, high, before, size


def positions(d: FrameDataset, start: int, end: int, n: int | None = None) -> DataFrame:
    """The frames at positions start..end, numbered; none outside the set."""
    if INDEX in d.df.columns:
        return d.df.where((F.col(INDEX) >= start) & (F.col(INDEX) < end))
    n = d.df.count() if n is None else n
    start, end = max(0, start), min(end, n)
    if start >= end:
        return d.df.where(F.lit(False)).withColumn(INDEX, F.lit(0).cast("long"))
    low, high, before, size = interval_of(d, start, end, n)
    found = with_index(d.df.where(_interval_test(d, low, high)), d.order, size)
    found = found.withColumn(INDEX, F.col(INDEX) + before) if before else found
    return found.where((F.col(INDEX) >= start) & (F.col(INDEX) < end))


def frame_at(d: FrameDataset, index: int) -> DataFrame:
    """The frame at a position; no row outside the set."""
    return positions(d, index, index + 1)


def key_at(d: FrameDataset, index: int) -> DataFrame:
    return frame_at(d, index).select(INDEX, F.col(f"`{d.schema.key.name}`"))


def boundary(d: FrameDataset, last: bool = False) -> DataFrame:
    """The first or last frame: one aggregate, no sort; no row if the set is empty."""
    row = F.struct(*[F.col(f"`{n}`") for n in d.df.columns])
    place = F.struct(*d.order)
    agg = F.max_by(row, place) if last else F.min_by(row, place)
    return d.df.agg(agg.alias("r")).where("r is not null").select("r.*")


def boundary_keys(d: FrameDataset) -> DataFrame:
    k = F.col(f"`{d.schema.key.name}`")
    return d.df.agg(F.count("*").alias("frame_count"), F.min_by(k, d.key).alias("first_key"), F.max_by(k, d.key).alias("last_key"))


def _ranks(d: FrameDataset, value) -> tuple:
    v = order_lit(d.schema.key, order_value(d.schema.key, value))
    return F.count_if(d.key < v).cast("long"), F.count_if(d.key <= v).cast("long")


def lower_bound(d: FrameDataset, value) -> DataFrame:
    """The first position whose key is not below value: the number of smaller keys."""
    return d.df.agg(_ranks(d, value)[0].alias("lower_bound"))


def upper_bound(d: FrameDataset, value) -> DataFrame:
    return d.df.agg(_ranks(d, value)[1].alias("upper_bound"))


def equal_range(d: FrameDataset, value) -> DataFrame:
    """Both bounds in one pass; an absent key gives the empty range at its place."""
    lo, hi = _ranks(d, value)
    return d.df.agg(lo.alias("start_idx"), hi.alias("end_idx"))


def equal_ranges(d: FrameDataset, values: list) -> DataFrame:
    """Bounds for a short list of keys in one pass: (key, start_idx, end_idx)."""
    aggs, rows = [], []
    for i, v in enumerate(values):
        lo, hi = _ranks(d, v)
        aggs += [lo.alias(f"s{i}"), hi.alias(f"e{i}")]
        rows.append(F.struct(F.lit(v).alias("key"), F.col(f"s{i}").alias("start_idx"), F.col(f"e{i}").alias("end_idx")))
    return d.df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def frames_slice(d: FrameDataset, start: int, end: int) -> DataFrame:
    """Half-open positions; an error outside the set."""
    n = d.df.count()
    if not 0 <= start <= end <= n:
        raise RangeError(f"frames {start}..{end} of {n}")
    return positions(d, start, end, n)


def frames_chunk(d: FrameDataset, start: int, limit: int) -> DataFrame:
    """At most `limit` frames from a position; clamped at the end, empty past it."""
    return positions(d, start, start + limit)


def frames_between(d: FrameDataset, low, high) -> DataFrame:
    """Keys from low to high, both included; a reversed range is empty."""
    f = d.schema.key
    a, b = order_value(f, low), order_value(f, high)
    return d.df.where(d.test(lambda k, lit: k.between(lit(a), lit(b))) if a <= b else F.lit(False))


def frames_before(d: FrameDataset, high) -> DataFrame:
    return d.df.where(d.test(lambda k, lit: k <= lit(order_value(d.schema.key, high))))


def frames_after(d: FrameDataset, low) -> DataFrame:
    return d.df.where(d.test(lambda k, lit: k >= lit(order_value(d.schema.key, low))))


def check_sorted(d: FrameDataset, keys: list) -> list:
    """Distinct order values of keys; an error unless they ascend."""
    values = [order_value(d.schema.key, k) for k in keys]
    for a, b in zip(values, values[1:], strict=False):
        if b < a:
            raise KeyOrderError(b, a, "key list")
    return list(dict.fromkeys(values))


def key_in(d: FrameDataset, keys: list, how: str) -> DataFrame:
    """Semi or anti join with a sorted key list: a pushed-down IN while it is short."""
    values = check_sorted(d, keys)
    if len(values) <= SMALL_LIST:
        hit = d.test(lambda k, lit: k.isin(*map(lit, values))) if values else F.lit(False)
        return d.df.where(hit if how == "left_semi" else ~hit)
    kind = d.df.select(d.key.alias("_k")).schema["_k"].dataType
    listed = d.df.sparkSession.createDataFrame([(v,) for v in values], "v " + kind.simpleString())
    return d.df.withColumn("_k", d.key).join(listed, F.col("_k") == F.col("v"), how).drop("_k")


def frames_by_keys(d: FrameDataset, keys: list) -> DataFrame:
    """Frames whose key is in a sorted list; repeats count once, absent keys give nothing."""
    return key_in(d, keys, "left_semi")


def select(d: FrameDataset, selectors: list[str]) -> DataFrame:
    """Frames of the union of selectors (none: all)."""
    return d.df.where(selection(d, parse_all(d.schema.key, selectors)))


def selection(d: FrameDataset, selectors: list[Selector]) -> Column:
    """The filter of a union of selectors, for d's rows."""
    return d.test(lambda k, lit: predicate(d.schema.key, selectors, k, lit))


def select_numbered(d: FrameDataset, selectors: list[str]) -> DataFrame:
    """The same with their positions in the whole set: only what is selected is sorted, and one pass counts what lies before."""
    f = d.schema.key
    parsed = parse_all(f, selectors)
    if INDEX in d.df.columns or not parsed:
        return d.numbered().df.where(predicate(f, parsed))
    apart = [Selector(*(None if v is None else key_of_order(f, v) for v in p)) for p in intervals(f, parsed)]
    found = merge(bounds(d.df, f, apart))
    picked = with_index(d.df.where(selection(d, parsed)), d.order, sum(e - s for s, e in found))
    shift, at = F.lit(None).cast("long"), 0
    for s, e in found:
        at += e - s
        shift = F.coalesce(shift, F.when(F.col(INDEX) < at, F.lit(e - at)))
    return picked.withColumn(INDEX, F.col(INDEX) + F.coalesce(shift, F.lit(0)))


def find(d: FrameDataset, selectors: list[str]) -> dict:
    """How many selectors, merged ranges and frames, and where the selection starts and ends."""
    ranges = resolve(d.df, d.schema.key, [Selector.parse(d.schema.key, s) for s in selectors])
    return {
        "selector_count": len(selectors), "range_count": len(ranges), "start_idx": ranges[0][0] if ranges else None,
        "end_idx": ranges[-1][1] if ranges else None, "frame_count": sum(e - s for s, e in ranges), "ranges": ranges,
    }


def preview(d: FrameDataset) -> DataFrame:
    """The first and last PREVIEW frames, or all if there are no more than twice as many."""
    n = d.df.count()
    return positions(d, 0, n, n) if n <= 2 * PREVIEW else positions(d, 0, PREVIEW, n).unionByName(positions(d, n - PREVIEW, n, n))



def as_of(d: FrameDataset, value) -> DataFrame:
    """Extension: the last frame at or before a key."""
    hits = FrameDataset(frames_before(d, value), d.schema, d.title, d.strings, d.ties)
    return boundary(hits, last=True)


def key_counts(d: FrameDataset) -> DataFrame:
    """Multiplicity of every key."""
    return d.df.groupBy(order_column(d.schema.key).alias("key")).agg(F.count("*").alias("n"))
