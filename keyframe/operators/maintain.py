"""Verification, repair, inspection and catalogues."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import FrameDataset
from ..plans.ordering import INDEX, violations, with_previous
from ..types import Family


def order_violations(d: FrameDataset, index: str = INDEX) -> DataFrame:
    """Frames below their predecessor in stored order; none if the set is sound."""
    return violations(d.df, d.key, index)


def contiguity_violations(zones: DataFrame, page: str = "page_id") -> DataFrame:
    """Pages that do not start where the one before ends."""
    t = with_previous(zones, page, F.col("first_frame_index") + F.col("frame_count"), "expected")
    return t.withColumn("expected", F.coalesce("expected", F.lit(0))).where(F.col("first_frame_index") != F.col("expected"))


def repair_cut(d: FrameDataset, index: str = INDEX) -> DataFrame:
    """(valid_frames): the length of the longest prefix in order."""
    first = order_violations(d, index).agg(F.min(index).alias("bad"), F.lit(None).cast("long").alias("n"))
    both = first.unionByName(d.df.agg(F.lit(None).cast("long").alias("bad"), F.count("*").alias("n")))
    return both.agg(F.coalesce(F.min("bad"), F.max("n")).cast("long").alias("valid_frames"))


def repair(d: FrameDataset, index: str = INDEX) -> FrameDataset:
    """The longest prefix in order."""
    n = repair_cut(d, index).first()[0]
    return replace(d, df=d.df.where(F.col(index) < n))


def verify(d: FrameDataset, index: str = INDEX) -> bool:
    return order_violations(d, index).isEmpty()


def light_verify(frame_count: int, zones: DataFrame) -> bool:
    """The header's count against the sum over pages."""
    return (zones.agg(F.sum("frame_count")).first()[0] or 0) == frame_count


def ls_row(d: FrameDataset, name: str) -> DataFrame:
    """One row of catalogue facts."""
    size = d.schema.frame_length
    return d.df.agg(
        F.lit(name).alias("name"), F.lit(d.title).alias("title"), F.lit(d.schema.frame_type).alias("frame_type"), F.lit(d.schema.key.name).alias("key_field"), F.lit(len(d.schema.fields)).cast("long").alias("field_count"),
        F.lit(len(d.strings)).cast("long").alias("string_count"), F.lit(size).cast("long").alias("frame_length"), F.count("*").alias("frame_count"), F.min(d.key).cast("string").alias("first_key"), F.max(d.key).cast("string").alias("last_key"),
        (F.count("*") * size).alias("data_bytes"),
    )


def ls(sets: dict[str, FrameDataset]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows for all datasets that can be read, and messages for the others."""
    out, errors = None, {}
    for name, d in sorted(sets.items(), key=lambda x: x[0].lower()):
        try:
            r = ls_row(d, name)
        except Exception as e:  # a bad file is reported, the others are listed
            errors[name] = str(e)
            continue
        out = r if out is None else out.unionByName(r)
    return out, errors


def inspect(d: FrameDataset) -> dict[str, dict]:
    """Header facts by section, for the TOML writer."""
    n = d.df.count()
    fields = {f.name: f"{f.family.name.lower()}:{f.length}:{f.semantic}" for f in d.schema.fields}
    return {
        "dataset": {"title": d.title, "frame_type": d.schema.frame_type, "frame_count": n, "frame_length": d.schema.frame_length, "data_bytes": n * d.schema.frame_length},
        "key": {"field": d.schema.key.name, "index": d.schema.key_index, "float_order": d.schema.key.family == Family.FLOAT},
        "fields": fields, "strings": {"count": len(d.strings), "values": list(d.strings)},
    }


def ratios(stored: int, payload: int, logical: int) -> dict[str, float | None]:
    """Payload and physical compression and page utilisation; None where nothing is stored."""
    div = lambda a, b: a / b if b else None
    return {"payload_ratio": div(payload, logical), "physical_ratio": div(stored, logical), "utilisation": div(payload, stored)}
