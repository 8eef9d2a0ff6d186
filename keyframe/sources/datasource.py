"""Spark data source `frames` for the two binary layouts.

Read options: path (a file or folder), key_index (version 1), columns (comma-separated; a
Python source cannot be told by Catalyst), low and high (key bounds that skip version-2
pages by their zone maps), strings=decode|code.  Rows carry _frame_index.
Write options: path, version, title, schema (JSON of Schema.to_dict), strings (JSON), page_size,
codec and encoding (or smallest, by page), level (zstd), packing (tight or estimate).  Each task writes one file; a folder is published by its commit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql import types as T

from ..errors import FormatError, LengthError, PageError
from ..functions.keys import float_order, parse_key
from ..types import Family, Schema
from . import layouts as L
from .frames import ENCODINGS, decode_columns, encode_columns, record_type

SUFFIX, TASK_BYTES = ".frames", 32 << 20  # the suffix of files that are written


def open_fs(path: str):
    """(file system, path) of pyarrow, for local and remote paths."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def discover(path: str | list[str], suffix: str = "") -> list[str]:
    """Files of inputs, each a file or a folder, without repeats, in case-insensitive order.

    Of a folder, those with the suffix in any case; without a suffix, those that begin
    with either layout's magic bytes, whatever their names.
    """
    from pyarrow import fs

    found = {}
    for one in [path] if isinstance(path, str) else path:
        f, p = open_fs(one)
        info = f.get_file_info(p)
        if info.type == fs.FileType.File:
            found[p] = one
            continue
        if info.type != fs.FileType.Directory:
            raise FormatError(f"no such file: {one}")
        root = one[: len(one) - len(p)] if "://" in one and one.endswith(p) else ""
        for x in f.get_file_info(fs.FileSelector(p)):
            if x.type != fs.FileType.File or x.path.endswith(".tmp") or not x.path.lower().endswith(suffix.lower()):
                continue
            if not suffix:
                with f.open_input_file(x.path) as h:
                    if h.read(4) not in (L.MAGIC_1, L.MAGIC_2):
                        continue
            found[x.path] = root + x.path
    return sorted(found.values(), key=str.lower)


def read_bytes(path: str, start: int, size: int) -> bytes:
    f, p = open_fs(path)
    with f.open_input_file(p) as h:
        h.seek(start)
        return h.read(size)


@dataclass(frozen=True)
class Opened:
    """A file's header facts."""

    path: str
    version: int
    schema: Schema
    title: str
    frame_count: int
    strings: tuple[str, ...]
    page_size: int = 0
    page_count: int = 0
    first_frame: int = 0


def open_file(path: str, key_index: int = 0, exact: bool = True) -> Opened:
    """Either layout, by its magic bytes; exact: the length must be what the header says."""
    head = read_bytes(path, 0, L.HEADER_2)
    f, p = open_fs(path)
    size = f.get_file_info(p).size
    if L.detect(head) == 1:
        h = L.read_header_1(head, key_index)
        strings = L.read_strings_1(read_bytes(path, L.HEADER_1, h.string_length), h.string_count)
        if exact and size != h.first_frame + h.frame_count * h.schema.frame_length:
            raise LengthError("file length")
        return Opened(path, 1, h.schema, h.title, h.frame_count, strings, first_frame=h.first_frame)
    h = L.read_header_2(head)
    if exact and size != L.HEADER_2 + h.page_count * h.page_size:
        raise LengthError("file length")
    return Opened(path, 2, h.schema, h.title, h.frame_count, h.strings, h.page_size, h.page_count)


def read_page(o: Opened, i: int) -> tuple[L.Page, np.ndarray]:
    try:
        return L.read_page(o.schema, read_bytes(o.path, L.HEADER_2 + i * o.page_size, o.page_size))
    except FormatError as e:
        raise PageError(i, e) from e


def chunk_rows(schema: Schema, page_size: int = L.DEFAULT_PAGE, pages: int = 4) -> int:
    """Frames that a writer should be given at a time: enough for some pages; for spark.sql.execution.arrow.maxRecordsPerBatch."""
    return max(1, pages * (page_size - L.PAGE_HEADER) // schema.frame_length)


def page_headers(o: Opened) -> list[L.Page]:
    f, p = open_fs(o.path)
    with f.open_input_file(p) as h:
        out = []
        for i in range(o.page_count):
            h.seek(L.HEADER_2 + i * o.page_size)
            out.append(L.read_page_header(o.schema, h.read(L.PAGE_HEADER)))
        return out


@dataclass
class Span(InputPartition):
    path: str
    start: int  # frame (version 1) or page (version 2)
    end: int
    base: int  # position of the file's first frame in the whole set


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.files = [open_file(p, int(options.get("key_index", 0))) for p in discover(options["path"].split("\n"), options.get("suffix", ""))]
        if not self.files:
            raise FormatError("no files")
        if any(not f.schema.compatible(self.files[0].schema) for f in self.files):
            raise FormatError("schemas differ")

    def partitions(self) -> list[Span]:
        out, base = [], 0
        key = self.files[0].schema.key
        place = (lambda v: float_order(v, key.length)) if key.family == Family.FLOAT and not key.is_decimal else (lambda v: v)
        low, high = (parse_key(key, self.options[k]) if k in self.options else None for k in ("low", "high"))
        for f in self.files:
            if f.version == 1:
                step = max(1, TASK_BYTES // f.schema.frame_length)
                out += [Span(f.path, a, min(a + step, f.frame_count), base) for a in range(0, f.frame_count, step)]
            else:
                pages = range(f.page_count)
                if low is not None or high is not None:
                    zones = page_headers(f)
                    pages = [i for i in pages if (low is None or place(zones[i].last_key) >= place(low)) and (high is None or place(zones[i].first_key) <= place(high))]
                step, run = max(1, TASK_BYTES // f.page_size), []
                for i in pages:
                    if run and (i != run[-1] + 1 or len(run) == step):
                        out.append(Span(f.path, run[0], run[-1] + 1, base))
                        run = []
                    run.append(i)
                if run:
                    out.append(Span(f.path, run[0], run[-1] + 1, base))
            base += f.frame_count
        return out or [Span(self.files[0].path, 0, 0, 0)]

    def read(self, span: Span):
        o = open_file(span.path, int(self.options.get("key_index", 0)))
        if o.version == 1:
            raw = read_bytes(o.path, o.first_frame + span.start * o.schema.frame_length, (span.end - span.start) * o.schema.frame_length)
            yield self._batch(o, np.frombuffer(raw, record_type(o.schema)), span.base + span.start)
            return
        for i in range(span.start, span.end):
            page, frames = read_page(o, i)
            yield self._batch(o, frames, span.base + page.first_index)

    def _batch(self, o: Opened, frames: np.ndarray, first: int):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        decode = self.options.get("strings", "decode") == "decode"
        columns = decode_columns(o.schema, frames, o.strings if decode else None)
        wanted = source_schema(o.schema, self.options)
        arrays = [pa.array(range(first, first + len(frames)), pa.int64()) if f.name == "_frame_index" else pa.array(columns[f.name], to_arrow_type(f.dataType)) for f in wanted.fields]
        return pa.RecordBatch.from_arrays(arrays, names=wanted.names)


def source_schema(s: Schema, options: dict) -> T.StructType:
    full = s.spark_schema(options.get("strings", "decode") == "decode")
    names = [n.strip() for n in options["columns"].split(",")] if options.get("columns") else s.names
    return T.StructType([T.StructField("_frame_index", T.LongType(), True), *[full[n] for n in names]])


@dataclass
class Written(WriterCommitMessage):
    path: str
    frames: int


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self.schema = Schema.from_dict(json.loads(options["schema"]))

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        s, strings = self.schema, tuple(json.loads(self.options.get("strings", "[]")))
        chunks = [encode_columns(s, {n: b.column(n).to_pylist() for n in s.names}, strings) for b in iterator]
        frames = np.concatenate(chunks) if chunks else np.zeros(0, record_type(s))
        context = TaskContext.get()
        # files are read in the order of their names, so those of a later append have a larger first number
        path = f"{self.options['path'].rstrip('/')}/part-{int(self.options.get('generation', 0)):06d}-{context.partitionId():05d}-{context.taskAttemptId()}{SUFFIX}"
        title = self.options.get("title", "untitled")
        if int(self.options.get("version", 2)) == 1:
            raw = L.write_file_1(s, title, strings, frames)
        else:
            encoding = self.options.get("encoding", "columnar-basic")
            encoding = encoding if encoding == "smallest" else ENCODINGS[encoding]
            raw = L.write_file_2(s, title, strings, frames, int(self.options.get("page_size", L.DEFAULT_PAGE)), self.options.get("codec", "zstd"), encoding, int(self.options.get("level", L.DEFAULT_LEVEL)), self.options.get("packing", "tight"))
        f, p = open_fs(path)
        f.create_dir(p.rpartition("/")[0], recursive=True)
        with f.open_output_stream(p + ".tmp") as h:
            h.write(raw)
        return Written(path, len(frames))

    def commit(self, messages) -> None:
        kept = {m.path for m in messages if m is not None}
        f, _ = open_fs(self.options["path"])
        before = []
        if self.overwrite:
            before = [open_fs(old)[1] for old in discover(self.options["path"])]
        for path in sorted(kept):
            p = open_fs(path)[1]
            f.move(p + ".tmp", p)
        for old in before:  # only when the new files are there
            f.delete_file(old)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                f, p = open_fs(m.path)
                f.delete_file(p + ".tmp")


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> T.StructType:
        files = discover(self.options["path"].split("\n"), self.options.get("suffix", ""))
        if not files:
            raise FormatError("no files")
        return source_schema(open_file(files[0], int(self.options.get("key_index", 0))).schema, dict(self.options))

    def reader(self, schema: T.StructType) -> FrameReader:
        return FrameReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(FrameSource)


def load(spark, path: str | list[str], **options: str):
    """A FrameDataset over files or folders of either layout."""
    from ..dataset import FrameDataset

    register(spark)
    reader = spark.read.format("frames").option("path", path if isinstance(path, str) else "\n".join(path))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    first = open_file(discover(path, options.get("suffix", ""))[0], int(options.get("key_index", 0)))
    return FrameDataset(reader.load(), first.schema, first.title, first.strings, ("_frame_index",), projected="columns" in options)


def save(d, path: str, version: int = 2, files: int = 1, **options: str) -> None:
    """Write a dataset as `files` files in key order (one range of keys each)."""
    df = d.frames().repartitionByRange(files, *d.order).sortWithinPartitions(*d.order) if files > 1 else d.df.coalesce(1).sortWithinPartitions(*d.order).select(*d.schema.names)
    register(df.sparkSession)
    w = df.write.format("frames").mode("append").option("path", path).option("version", str(version)).option("title", d.title)
    w = w.option("schema", json.dumps(d.schema.to_dict())).option("strings", json.dumps(list(d.strings)))
    for k, v in options.items():
        w = w.option(k, str(v))
    w.save()


def append(spark, path: str, d, **options: str) -> int:
    """Add a dataset's frames behind those of a folder, as files of their own; how many.

    Schemas and string tables must be equal and no key may be below the last one stored.
    """
    from pyspark.sql import functions as F

    from ..errors import IncompatibleError, KeyOrderError, StringTableError
    from ..functions.keys import order_value

    target = load(spark, path)
    if not target.schema.compatible(d.schema):
        raise IncompatibleError("schemas differ")
    if target.strings != d.strings:
        raise StringTableError("string tables differ")
    name = F.col(f"`{d.schema.key.name}`")
    last = target.df.agg(F.max_by(name, target.key)).first()[0]
    n, first = d.df.agg(F.count("*"), F.min_by(name, d.key)).first()
    if n and last is not None and order_value(d.schema.key, first) < order_value(d.schema.key, last):
        raise KeyOrderError(first, last, "append")
    opened = [open_file(p) for p in discover(path)]
    if n:
        own = {"page_size": opened[-1].page_size} if opened[-1].version == 2 else {}
        save(d, path, opened[-1].version, generation=len(opened), **(own | options))
    return n


def verify_file(path: str, key_index: int = 0) -> int:
    """Read everything: header, length, checksums, contiguous pages, key order, total; the number of frames."""
    o = open_file(path, key_index)
    last, n = None, 0
    for first, frames in _file_pages(o):
        if first != n:
            raise FormatError("pages are not contiguous")
        order = _order(o.schema, frames)
        if (order[1:] < order[:-1]).any() or (len(order) and last is not None and order[0] < last):
            raise FormatError("keys out of order")
        last, n = (order[-1] if len(order) else last), n + len(frames)
    if n != o.frame_count:
        raise FormatError("frame count")
    return n


def _order(s: Schema, frames: np.ndarray) -> np.ndarray:
    c = frames[s.key.name]
    if s.key.is_decimal:
        from ..functions.keys import decode_decimal

        return np.array([decode_decimal(bytes(x)) for x in c], object)
    if s.key.family == Family.FLOAT:
        b = np.ascontiguousarray(c).view(f"<i{s.key.length}")
        return np.where(b >= 0, b, b ^ np.iinfo(b.dtype).max)
    return c


def _file_pages(o: Opened):
    if o.version == 1:
        yield 0, np.frombuffer(read_bytes(o.path, o.first_frame, o.frame_count * o.schema.frame_length), record_type(o.schema))
        return
    for i in range(o.page_count):
        page, frames = read_page(o, i)
        yield page.first_index, frames


def repair_file(path: str, key_index: int = 0) -> int:
    """Version 1: committed frames must be in order; whole ordered frames after them are adopted, the rest goes.
    Version 2: the longest prefix of sound pages stays.  Returns the number of frames."""
    o = open_file(path, key_index, exact=False)
    f, p = open_fs(path)
    size = f.get_file_info(p).size
    if o.version == 1:
        width = o.schema.frame_length
        held = max(0, size - o.first_frame) // width
        frames = np.frombuffer(read_bytes(path, o.first_frame, held * width), record_type(o.schema))
        order = _order(o.schema, frames)
        bad = np.flatnonzero(order[1:] < order[:-1]) + 1
        n = int(bad[0]) if len(bad) else held
        if n < min(o.frame_count, held):
            raise FormatError("committed frames are out of order")
        raw = L.write_file_1(o.schema, o.title, o.strings, frames[:n])
    else:
        n, last, pages = 0, None, []
        for i in range(max(0, size - L.HEADER_2) // o.page_size):
            data = read_bytes(path, L.HEADER_2 + i * o.page_size, o.page_size)
            try:
                page, frames = L.read_page(o.schema, data)
            except FormatError:
                break
            order = _order(o.schema, frames)
            if page.first_index != n or (order[1:] < order[:-1]).any() or (last is not None and order[0] < last):
                break
            n, last = n + len(frames), order[-1]
            pages.append(data)
        raw = L.write_header_2(L.Header2(o.schema, o.title, o.page_size, len(pages), n, o.strings)) + b"".join(pages)
    with f.open_output_stream(p + ".tmp") as h:
        h.write(raw)
    f.move(p + ".tmp", p)
    return n


def convert(spark, path: str, out: str, version: int = 2, **options: str) -> None:
    """Any layout into any other; a folder is one job over all its files."""
    save(load(spark, path), out, version, **options)
