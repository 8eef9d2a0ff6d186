"""Pages: fixed runs of consecutive frames with zone maps, statistics and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import FrameDataset
from ..plans.ordering import INDEX, with_previous, with_sum_before

PAGE = "page_id"


def paged(d: FrameDataset, rows: int) -> DataFrame:
    """Each frame with its page."""
    return d.numbered().df.withColumn(PAGE, F.floor(F.col(INDEX) / rows).cast("long"))


def zone_map(d: FrameDataset, rows: int, label: Column | None = None) -> DataFrame:
    """One row per page: first and last position and key, frames, and the largest label."""
    t = paged(d, rows)
    aggs = [F.min(INDEX).alias("first_frame_index"), F.count("*").alias("frame_count"), F.min(d.key).alias("first_key"), F.max(d.key).alias("last_key")]
    if label is not None:
        aggs.append(F.max(label).alias("label"))
    return t.groupBy(PAGE).agg(*aggs)


def page_stats(zones: DataFrame) -> DataFrame:
    return zones.agg(F.count("*").alias("page_count"), F.sum("frame_count").alias("frame_count"), F.min("frame_count").alias("min_frames"), F.max("frame_count").alias("max_frames"))


def page_runs(zones: DataFrame, label: str = "label") -> DataFrame:
    """Maximal runs of consecutive pages of one label."""
    t = with_previous(zones, PAGE, F.struct(F.col(label).alias("label")), "_preceding")
    t = t.withColumn("_new", F.when(F.col("_preceding").isNotNull() & F.col(label).eqNullSafe(F.col("_preceding.label")), 0).otherwise(1))
    t = with_sum_before(t, PAGE, F.col("_new"), "_sum").withColumn("run", F.col("_sum") + F.col("_new"))
    return t.groupBy("run").agg(
        F.max(label).alias("label"), F.min(PAGE).alias("first_page"), F.max(PAGE).alias("last_page"), F.sum("frame_count").alias("frame_count"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")
    )


def page_for_index(zones: DataFrame, index: int) -> DataFrame:
    """The page that holds a position; no row outside the set."""
    hit = (F.col("first_frame_index") <= index) & (index < F.col("first_frame_index") + F.col("frame_count"))
    return zones.where(hit).select(PAGE)


def page_for_key(zones: DataFrame, key) -> DataFrame:
    """The first page whose last key is not below key, if its first key is not above: no row in a gap."""
    first = zones.where(F.col("last_key") >= F.lit(key)).agg(F.min_by(F.struct(PAGE, "first_key"), PAGE).alias("p"))
    return first.where(F.col("p.first_key") <= F.lit(key)).select(f"p.{PAGE}")


def prefix_sums(zones: DataFrame) -> DataFrame:
    """first_frame_index of each page as the sum of frames before it."""
    return with_sum_before(zones.select(PAGE, "frame_count"), PAGE, F.col("frame_count"), "first_frame_index")


def delta_encode(d: FrameDataset, rows: int, column: str, bits: int = 64) -> DataFrame:
    """Per page, the first value and then differences, wrapped to `bits`."""
    w = Window.partitionBy(PAGE).orderBy(INDEX)
    c = F.col(column).cast("decimal(38,0)")
    delta = wrap(c - F.coalesce(F.lag(c).over(w), F.lit(0).cast("decimal(38,0)")), bits)
    return paged(d, rows).withColumn("delta", delta)


def delta_decode(encoded: DataFrame, bits: int = 64, out: str = "value") -> DataFrame:
    """Running sums of differences per page, wrapped."""
    w = Window.partitionBy(PAGE).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    return encoded.withColumn(out, wrap(F.sum(F.col("delta").cast("decimal(28,0)")).over(w), bits))


def wrap(c: Column, bits: int) -> Column:
    """Two's-complement reduction to a signed integer of `bits`."""
    span, half = F.lit(str(1 << bits)).cast("decimal(38,0)"), F.lit(str(1 << (bits - 1))).cast("decimal(38,0)")
    return (F.pmod(c.cast("decimal(38,0)") + half, span) - half).cast("long")
