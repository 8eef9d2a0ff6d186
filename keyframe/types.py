"""Field families, widths, display semantics and schema rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import types as T

from .errors import SchemaError


class Family(IntEnum):
    SIGNED = 0
    UNSIGNED = 1
    FLOAT = 2
    UTF8 = 3
    STRING_INDEX = 4


#: Widths in bytes that a family may have; a 16-byte float is a decimal.
WIDTHS = {Family.SIGNED: (1, 2, 4, 8), Family.UNSIGNED: (1, 2, 4, 8), Family.FLOAT: (4, 8, 16), Family.STRING_INDEX: (1, 2, 4, 8)}
LETTERS = {"i": Family.SIGNED, "u": Family.UNSIGNED, "f": Family.FLOAT, "utf8": Family.UTF8, "sidx": Family.STRING_INDEX}
MAX_POINTS = 8
#: Ids of semantics on disk.
UNIX_IDS = {"unix-seconds": 1, "unix-milliseconds": 2, "unix-microseconds": 3, "unix-nanoseconds": 4}
FIXED_ID, PERCENT_ID = 6, 16
INTEGERS = (Family.SIGNED, Family.UNSIGNED)


@dataclass(frozen=True)
class Semantic:
    """kind: none, unix-seconds ... unix-nanoseconds, fixed, percent; points for the last two."""

    kind: str = "none"
    points: int = 0

    @classmethod
    def parse(cls, text: str) -> Semantic:
        if text in ("", "none"):
            return cls()
        if text in UNIX_IDS:
            return cls(text)
        m = re.fullmatch(r"(fixed|percent)-(\d+)", text)
        if not m or int(m[2]) > MAX_POINTS:
            raise SchemaError(f"unknown semantic {text!r}")
        return cls(m[1], int(m[2]))

    @classmethod
    def from_id(cls, number: int) -> Semantic:
        for kind, n in UNIX_IDS.items():
            if n == number:
                return cls(kind)
        if number == 0:
            return cls()
        for kind, first in (("fixed", FIXED_ID), ("percent", PERCENT_ID)):
            if first <= number <= first + MAX_POINTS:
                return cls(kind, number - first)
        raise SchemaError(f"reserved semantic id {number}")

    @property
    def id(self) -> int:
        return UNIX_IDS.get(self.kind, {"none": 0, "fixed": FIXED_ID + self.points, "percent": PERCENT_ID + self.points}.get(self.kind, 0))

    def __str__(self) -> str:
        return f"{self.kind}-{self.points}" if self.kind in ("fixed", "percent") else self.kind


@dataclass(frozen=True)
class Field:
    name: str
    family: Family
    length: int
    semantic: Semantic = Semantic()

    @classmethod
    def parse(cls, text: str) -> Field:
        """`name:type:width[:semantic]`, the type being i, u, f, utf8 or sidx."""
        parts = text.split(":")
        if len(parts) not in (3, 4) or parts[1] not in LETTERS or not parts[2].isdigit():
            raise SchemaError(f"bad field {text!r}")
        return cls(parts[0], LETTERS[parts[1]], int(parts[2]), Semantic.parse(parts[3]) if len(parts) == 4 else Semantic())

    @property
    def is_decimal(self) -> bool:
        return self.family == Family.FLOAT and self.length == 16

    def spark_type(self, scale: int = 10) -> T.DataType:
        """Unsigned integers take the next wider signed type; u64 is DECIMAL(20,0)."""
        if self.family == Family.SIGNED:
            return {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}[self.length]
        if self.family in (Family.UNSIGNED, Family.STRING_INDEX):
            return {1: T.ShortType(), 2: T.IntegerType(), 4: T.LongType(), 8: T.DecimalType(20, 0)}[self.length]
        if self.family == Family.FLOAT:
            return {4: T.FloatType(), 8: T.DoubleType(), 16: T.DecimalType(38, scale)}[self.length]
        return T.StringType()

    def limits(self) -> tuple[int, int]:
        """Least and largest integer value."""
        bits = 8 * self.length
        return (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if self.family == Family.SIGNED else (0, (1 << bits) - 1)


@dataclass(frozen=True)
class Schema:
    frame_type: str
    fields: tuple[Field, ...]
    key_index: int = 0

    def __post_init__(self) -> None:
        if not self.frame_type:
            raise SchemaError("empty frame type")
        if not self.fields:
            raise SchemaError("no fields")
        if not 0 <= self.key_index < len(self.fields):
            raise SchemaError("key index out of range")
        seen = set()
        for f in self.fields:
            if not f.name or f.name in seen:
                raise SchemaError(f"empty or repeated field name {f.name!r}")
            seen.add(f.name)
            if f.length <= 0 or f.length not in WIDTHS.get(f.family, (f.length,)):
                raise SchemaError(f"{f.name}: width {f.length} is not one of {f.family.name}'s")
            if f.semantic.kind != "none" and f.family not in INTEGERS:
                raise SchemaError(f"{f.name}: only integers carry a semantic")
            if f.semantic.points > MAX_POINTS:
                raise SchemaError(f"{f.name}: more than {MAX_POINTS} decimal places")
        if self.frame_length > (1 << 32) - 1:
            raise SchemaError("frame too long")
        if self.key.family == Family.UTF8:
            raise SchemaError("strings have no key order")

    @classmethod
    def parse(cls, frame_type: str, fields: str, key: str | int = 0) -> Schema:
        """Fields as comma-separated `name:type:width[:semantic]`."""
        found = tuple(Field.parse(x.strip()) for x in fields.split(","))
        index = key if isinstance(key, int) else next((i for i, f in enumerate(found) if f.name == key), -1)
        return cls(frame_type, found, index)

    @property
    def key(self) -> Field:
        return self.fields[self.key_index]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def frame_length(self) -> int:
        return sum(f.length for f in self.fields)

    def offsets(self) -> list[int]:
        return [sum(f.length for f in self.fields[:i]) for i in range(len(self.fields))]

    def compatible(self, other: Schema) -> bool:
        """Equal but for semantics."""
        plain = lambda s: (s.frame_type, s.key_index, tuple(replace(f, semantic=Semantic()) for f in s.fields))
        return plain(self) == plain(other)

    def richness(self) -> int:
        return sum(f.semantic.kind != "none" for f in self.fields)

    def with_semantics(self, found: dict[str, str | Semantic]) -> Schema:
        if missing := set(found) - set(self.names):
            raise SchemaError(f"no field {sorted(missing)[0]!r}")
        return replace(self, fields=tuple(replace(f, semantic=Semantic.parse(s) if isinstance(s := found[f.name], str) else s) if f.name in found else f for f in self.fields))

    def renamed(self, names: dict[str, str]) -> Schema:
        if missing := set(names) - set(self.names):
            raise SchemaError(f"no field {sorted(missing)[0]!r}")
        return replace(self, fields=tuple(replace(f, name=names.get(f.name, f.name)) for f in self.fields))

    def spark_schema(self, decode_strings: bool = True) -> T.StructType:
        out = []
        for f, at in zip(self.fields, self.offsets(), strict=True):
            kind = T.StringType() if decode_strings and f.family == Family.STRING_INDEX else f.spark_type()
            out.append(T.StructField(f.name, kind, True, {"family": f.family.name, "length": f.length, "offset": at, "semantic": str(f.semantic)}))
        return T.StructType(out)

    def to_dict(self) -> dict:
        return {"frame_type": self.frame_type, "key_index": self.key_index, "fields": [[f.name, int(f.family), f.length, str(f.semantic)] for f in self.fields]}

    @classmethod
    def from_dict(cls, d: dict) -> Schema:
        return cls(d["frame_type"], tuple(Field(n, Family(k), w, Semantic.parse(s)) for n, k, w, s in d["fields"]), d["key_index"])


def richest(schemas: list[Schema]) -> Schema:
    """The schema with most semantics, the first of equals."""
    return max(schemas, key=Schema.richness)
