"""Packing into fixed windows by best-fit decreasing (operator 8).

Each document's ids, closed by id 0, are cut into full windows; what remains of
it goes, longest first, to the open window with the least room that still
holds it.  A segment tree over the room left (0 to WINDOW) finds that window.
Windows are packed per group of about GROUP pieces, dealt by their place in the
written table of pieces, so each task is bounded, however long or often repeated a
document is; one group leaves a few windows short of full, whatever its size.

Null text: the document is its closing id.  Repeated rows are packed as often as
they come; a null doc_id is kept.  Other columns are ignored.  A text of any length
is one row: its task holds some 50 bytes for each of its bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_buffer, trimmed
from .tokens import token_rows

WINDOW, GROUP, CLOSING = 1024, 40_000, 0


class Rooms:
    """A segment tree over room left: how many open windows have it."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room >= need that an open window has."""
        count, i = self.count, need + self.leaves
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def take(self, room: int) -> int:
        i = room + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each piece of 1 to window ids; ties keep their order."""
    n = len(lengths)
    number, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rooms, used = Rooms(window), 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        room = rooms.tightest(sizes[i])
        if room is None:
            room, w = window, used
            used += 1
        else:
            w = rooms.take(room)
        number[i], offset[i] = w, window - room
        if room > sizes[i]:
            rooms.add(room - sizes[i], w)
    return number, offset


def _pieces(path: str, window: int):
    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            data, offs = text_buffer(b.column(1))
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), token_rows(path, data, offs), strict=True):
                ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                for s in range(0, len(ids), window):
                    p = ids[s : s + window]
                    out.append((doc, s, len(p), zlib.crc32(p.tobytes()), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return trimmed(run)


def _pack(window: int):
    def run(key, t):
        import pyarrow as pa

        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        number, offset = best_fit_decreasing(np.asarray(t.column("length")), window)
        t = t.drop_columns(["g"])
        return t.append_column("sequence_id", pa.array((key[0].as_py() << 32) + number)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = cut(texts.mapInArrow(_pieces(path, window), columns))
    groups = max(1, -(-pieces.count() // GROUP))
    t = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # the table is written, so places are fixed
    return t.groupBy("g").applyInArrow(_pack(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _vocabulary())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each piece of each document goes.  Rows without id, without text and repeated ones are packed as they come."""
    return pack(docs, _vocabulary())
