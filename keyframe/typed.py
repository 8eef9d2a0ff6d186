"""Dataclasses as row types."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Annotated, Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession

from .dataset import FrameDataset
from .errors import RangeError, SchemaError
from .operators import mutate, read
from .types import LETTERS, Field, Schema, Semantic


@dataclass(frozen=True)
class Col:
    """How a field is stored: `i:4`, `u:8`, `f:8`, `utf8:4`, `sidx:2`; a key; a semantic; ignored."""

    store: str = ""
    key: bool = False
    semantic: str = "none"
    ignore: bool = False


def schema_of(cls: type, frame_type: str | None = None) -> Schema:
    """The schema of a dataclass whose fields are Annotated[type, Col(...)]; exactly one is the key."""
    if not dataclasses.is_dataclass(cls):
        raise SchemaError(f"{cls.__name__} is not a dataclass")
    hints, out, key = get_type_hints(cls, include_extras=True), [], []
    for f in dataclasses.fields(cls):
        hint = hints[f.name]
        col = next((a for a in get_args(hint)[1:] if isinstance(a, Col)), None) if get_origin(hint) is Annotated else None
        if col is None:
            raise SchemaError(f"{f.name} has no Col")
        if col.ignore:
            if col.key:
                raise SchemaError(f"{f.name} is ignored and cannot be the key")
            continue
        kind, _, width = col.store.partition(":")
        if kind not in LETTERS or not width.isdigit():
            raise SchemaError(f"{f.name}: {col.store!r}")
        if col.key:
            key.append(len(out))
        out.append(Field(f.name, LETTERS[kind], int(width), Semantic.parse(col.semantic)))
    if len(key) != 1:
        raise SchemaError("exactly one field must be the key")
    return Schema(frame_type or cls.__name__, tuple(out), key[0])


def dataset_of(spark: SparkSession, cls: type, rows: list[Any], title: str = "untitled", strings: tuple[str, ...] = ()) -> FrameDataset:
    """A dataset of instances, in their order among equal keys."""
    s = schema_of(cls)
    kinds = s.spark_schema().add("_seq", "long")
    df = spark.createDataFrame([(*[getattr(r, n) for n in s.names], i) for i, r in enumerate(rows)], kinds)
    return FrameDataset(df, s, title, strings, ("_seq",))


def checked(d: FrameDataset, cls: type, strict: bool = True) -> Schema:
    """The class's schema, which must be the dataset's (but for semantics, if not strict)."""
    want = schema_of(cls, d.schema.frame_type)
    if not (d.schema == want if strict else d.schema.compatible(want)):
        raise SchemaError(f"{cls.__name__} does not describe these frames")
    return want


def rows_of(d: FrameDataset, cls: type, df: DataFrame | None = None, strict: bool = True, start: int | None = None, end: int | None = None):
    """Instances in order, one partition at a time; of positions start..end only, if given."""
    want = checked(d, cls, strict)
    if start is not None or end is not None:
        df = read.positions(d, start or 0, (1 << 62) if end is None else end)
    ignored = {f.name: None for f in dataclasses.fields(cls) if f.name not in want.names}
    for r in (df if df is not None else d.df).orderBy(*d.order).toLocalIterator():
        yield cls(**{n: r[n] for n in want.names}, **ignored)


class TypedEditor:
    """Edits of a dataset by instances of a class; each returns what it did, and `dataset` is what is left."""

    def __init__(self, d: FrameDataset, cls: type, strict: bool = True) -> None:
        checked(d, cls, strict)
        self.dataset, self.cls = d, cls

    def get(self, index: int) -> Any:
        found = list(rows_of(self.dataset, self.cls, start=index, end=index + 1, strict=False))
        if not found:
            raise RangeError(f"no frame {index}")
        return found[0]

    def append(self, rows: list[Any]) -> int:
        """Instances in order, none with a key below the last one's; all or none are added."""
        d = dataset_of(self.dataset.df.sparkSession, self.cls, rows)
        self.dataset = mutate.append_transactional(self.dataset, d.df, "_seq")
        return len(rows)

    def delete(self, index: int) -> bool:
        self.dataset, found = mutate.delete_frame(self.dataset, index)
        return found

    def delete_keys(self, keys: list) -> int:
        self.dataset, n = mutate.delete_keys(self.dataset, keys)
        return n

    def delete_between(self, low, high) -> int:
        self.dataset, n = mutate.delete_key_range(self.dataset, low, high)
        return n
