"""The native store: a Parquet folder and JSON headers, on any file system that Spark reads."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import FrameDataset
from ..errors import FormatError, IncompatibleError
from ..functions.keys import order_value
from ..types import Schema

DATA, DEAD = "frames", "dead"
HEADER = re.compile(r"header-(\d{12})\.json")
#: Headers that are kept, so that a reader that has seen one can still open it.
KEPT_HEADERS = 3


def mark_to_json(value):
    """A key as JSON: integers as they are, other kinds by their exact text."""
    if isinstance(value, Decimal):
        return {"decimal": str(value)}
    return {"float": repr(value)} if isinstance(value, float) else value


def mark_from_json(value):
    if isinstance(value, dict):
        return Decimal(value["decimal"]) if "decimal" in value else float(value["float"])
    return value


@dataclass
class Store:
    """Frames are laid out by key range and sorted within each file, so key filters prune row groups.

    Each change writes folders of its own and then publishes them by renaming a new
    header into place, under the next number: a crash before leaves the store as it was,
    and of two writers one finds the number taken.  The largest number counts.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _headers(self) -> list[int]:
        path, fs = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(path(self.path)) if (m := HEADER.fullmatch(s.getPath().getName())))

    def _name(self, number: int) -> str:
        return f"{self.path}/header-{number:012d}.json"

    def exists(self) -> bool:
        return bool(self._headers())

    def _read(self) -> dict:
        found = self._headers()
        if not found:
            raise FormatError(f"{self.path} has no header")
        path, fs = self._fs()
        stream = fs.open(path(self._name(found[-1])))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": found[-1]}

    def _publish(self, header: dict, after: int) -> None:
        """The commit point."""
        path, fs = self._fs()
        part, final = path(f"{self.path}/.header-{uuid.uuid4().hex}"), path(self._name(after + 1))
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(header | {"number": after + 1}, indent=1).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(part, final):
            fs.delete(part, False)
            raise IncompatibleError(f"{self.path} was changed meanwhile")
        for old in self._headers()[:-KEPT_HEADERS]:
            fs.delete(path(self._name(old)), False)

    def _folder(self) -> str:
        return f"{DATA}/{uuid.uuid4().hex}"

    def _write(self, d: FrameDataset) -> str:
        """All frames of d in the store's layout, in a folder of their own."""
        folder, n = self._folder(), max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        d.frames().repartitionByRange(n, *d.order).sortWithinPartitions(*d.order).write.parquet(f"{self.path}/{folder}")
        return folder

    def create(self, d: FrameDataset, mode: str = "errorifexists") -> None:
        """Write a whole dataset, sorted by its order."""
        found = self._headers()
        if found and mode == "errorifexists":
            raise FormatError(f"{self.path} exists")
        folder = self._write(d)
        stored = FrameDataset(self.spark.read.schema(d.frames().schema).parquet(f"{self.path}/{folder}"), d.schema)
        n, top = stored.df.agg(F.count("*"), F.max_by(F.col(f"`{d.schema.key.name}`"), stored.key)).first()
        header = {"schema": d.schema.to_dict(), "columns": json.loads(d.frames().schema.json()), "title": d.title, "strings": list(d.strings), "ties": list(d.ties), "frame_count": n, "high_water": mark_to_json(top), "folders": [folder], "stream": -1}
        self._publish(header, found[-1] if found else 0)

    def dataset(self, spark: SparkSession | None = None) -> FrameDataset:
        """Only what the header lists has been committed."""
        from pyspark.sql.types import StructType

        h = self._read()
        schema = Schema.from_dict(h["schema"])
        df = (spark or self.spark).read.schema(StructType.fromJson(h["columns"])).parquet(*[f"{self.path}/{f}" for f in h["folders"]])
        for f in schema.spark_schema().fields:
            df = df.withMetadata(f.name, f.metadata)
        return FrameDataset(df, schema, h["title"], tuple(h["strings"]), tuple(h["ties"]))

    def header(self) -> dict:
        """Facts that need no scan: title, frame_count, high_water and so on."""
        return self._read()

    def high_water(self):
        """The largest key stored."""
        return mark_from_json(self._read()["high_water"]) if self.exists() else None

    def last_batch(self) -> int:
        """The number of the last micro-batch that a stream has appended."""
        return self._read()["stream"] if self.exists() else -1

    def append(self, batch: DataFrame, order: list[str], number: int | None = None) -> None:
        """Add a sorted batch; its files count once a header lists them.  number is a stream's batch number."""
        h = self._read()
        schema, folder = Schema.from_dict(h["schema"]), self._folder()
        rows = FrameDataset(batch, schema).frames()
        rows.sort(*order).write.parquet(f"{self.path}/{folder}")
        stored = FrameDataset(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}"), schema)
        n, top = stored.df.agg(F.count("*"), F.max_by(F.col(f"`{schema.key.name}`"), stored.key)).first()
        marks = [m for m in (mark_from_json(h["high_water"]), top) if m is not None]
        h["high_water"] = mark_to_json(max(marks, key=lambda m: order_value(schema.key, m))) if marks else None
        h["folders"] = [*h["folders"], folder] if n else h["folders"]
        h["frame_count"] += n
        h["stream"] = h["stream"] if number is None else number
        self._publish(h, h["number"])

    def append_dead(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{DEAD}/batch={number}")

    def set_header(self, d: FrameDataset) -> None:
        """Title, frame type, semantics and strings, without touching frames."""
        h = self._read()
        old = Schema.from_dict(h["schema"])
        if old.names != d.schema.names or not old.compatible(replace(d.schema, frame_type=old.frame_type)):
            raise IncompatibleError("only titles, types, semantics and strings can change in place")
        self._publish(h | {"schema": d.schema.to_dict(), "title": d.title, "strings": list(d.strings)}, h["number"])

    def compact(self) -> None:
        """All batches as one sorted layout; a stream goes on after the batch that it had reached."""
        h = self._read()
        self._publish(h | {"folders": [self._write(self.dataset())]}, h["number"])

    def vacuum(self) -> int:
        """Delete folders that no kept header lists; how many went.  No writer may be at work."""
        path, fs = self._fs()
        used = set()
        for number in self._headers():
            stream = fs.open(path(self._name(number)))
            used |= set(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"])
            stream.close()
        names = [f"{DATA}/{s.getPath().getName()}" for s in fs.listStatus(path(f"{self.path}/{DATA}"))]
        gone = [n for n in names if n not in used]
        for n in gone:
            fs.delete(path(f"{self.path}/{n}"), True)
        return len(gone)
