"""Ordered appends from a stream, gated by the stored high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KeyOrderError
from ..functions.keys import order_column, order_lit, order_value
from ..sources.store import Store


def ordered_append(store: Store, order: list[str], late: str = "fail"):
    """A foreachBatch function: each micro-batch is sorted by `order` and appended if no key is below
    the stored maximum (equal keys may follow).  Late rows fail the query, or with late="drop" go to
    the store's dead-letter table.  A batch that was committed before a restart is skipped by its number,
    so results do not depend on where the stream is cut or resumed.
    """

    def run(batch: DataFrame, number: int) -> None:
        if number <= store.last_batch():
            return
        d, mark = store.dataset(batch.sparkSession), store.high_water()
        if mark is not None:
            f = d.schema.key
            below = order_column(f) < order_lit(f, order_value(f, mark))
            if late == "fail":
                worst = batch.where(below).agg(F.min_by(F.col(f"`{f.name}`"), order_column(f))).first()[0]
                if worst is not None:
                    raise KeyOrderError(worst, mark, f"batch {number}")
            else:
                store.append_dead(batch.where(below), number)
                batch = batch.where(~below)
        store.append(batch, order, number)

    return run


def append_stream(stream: DataFrame, store: Store, order: list[str], checkpoint: str, late: str = "fail", available_now: bool = True):
    """Start the query; with available_now it ends when the input is used up."""
    w = stream.writeStream.foreachBatch(ordered_append(store, order, late)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
