"""Frame positions and the order gate."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "_frame_index"
#: Rows up to which one sorted window is used; beyond it, one range partition per so many rows.
WINDOW_ROWS = 1_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; one of the machine's own is made only on a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="frames-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_index(df: DataFrame, order: list[Column | str], rows: int | None = None, name: str = INDEX) -> DataFrame:
    """Add the 0-based global position in `order`, which must be total.

    A large set is range-partitioned on the whole order (so a key that holds many
    rows is split by what follows it), written once, and numbered within each
    partition from the partition's offset; offsets are one row per partition.
    """
    rows = df.count() if rows is None else rows
    if rows <= WINDOW_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    n = -(-rows // WINDOW_ROWS)
    laid = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    laid = laid.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = laid.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # one row per WINDOW_ROWS rows
    return laid.join(F.broadcast(offsets) if n <= 100_000 else offsets, "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def _chunk(order: str) -> Column:
    return F.floor(F.col(order) / WINDOW_ROWS).cast("long")


def with_previous(df: DataFrame, order: str, column: Column, name: str) -> DataFrame:
    """Add the value that column has in the row before, by the distinct integers in `order`.

    Rows are compared within chunks of WINDOW_ROWS places, and the first of a chunk with
    the last of the chunk before, so only one row for each chunk is ever sorted alone.
    """
    t = df.withColumn("_v", column).withColumn("_chunk", _chunk(order))
    lasts = t.groupBy("_chunk").agg(F.max_by(F.struct("_v"), order).alias("_last"))
    lasts = lasts.select("_chunk", F.lag("_last").over(Window.orderBy("_chunk")).alias("_before"))
    w = Window.partitionBy("_chunk").orderBy(order)
    inside = F.lag(F.struct("_v")).over(w)
    return t.join(lasts, "_chunk").withColumn(name, F.coalesce(inside, "_before")["_v"]).drop("_v", "_chunk", "_before")


def with_sum_before(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Add the sum of value over all rows before, by the distinct integers in `order`; from sums of chunks in the same way."""
    t = df.withColumn("_v", value).withColumn("_chunk", _chunk(order))
    sums = t.groupBy("_chunk").agg(F.sum("_v").alias("_sum"))
    sums = sums.select("_chunk", F.sum("_sum").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return t.join(sums, "_chunk").withColumn(name, (F.coalesce("_before", F.lit(0)) + F.coalesce(inside, F.lit(0))).cast("long")).drop("_v", "_chunk", "_before")


def violations(df: DataFrame, key: Column, index: str = INDEX) -> DataFrame:
    """Rows whose key is below the key before them in index order, with that key as `previous_key`."""
    return with_previous(df, index, key, "previous_key").where(key < F.col("previous_key"))


def merged_ranges(ranges: DataFrame, start: str = "start_idx", end: str = "end_idx") -> DataFrame:
    """Half-open ranges joined where they overlap or touch; empty ones go."""
    r = ranges.where(F.col(start) < F.col(end)).select(start, end)
    w = Window.orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_new", F.when(F.coalesce(reach < F.col(start), F.lit(True)), 1).otherwise(0))
    r = r.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("_group").agg(F.min(start).alias(start), F.max(end).alias(end)).select(start, end)
