"""Facts and checks of files, read page by page on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions.keys import float_order
from ..types import Family, Schema
from . import layouts as L
from .datasource import TASK_BYTES, _order, discover, open_file, open_fs, read_bytes
from .frames import CODECS, ENCODINGS, record_type

PAGE_FACTS = "path string, page long, version int, codec string, encoding string, frame_count long, payload_bytes long, stored_bytes long, padding long, first_frame_index long, first_key string, last_key string, first_rank string, last_rank string, problem string"
FILE_FACTS = "path string, version int, title string, frame_type string, key_field string, field_count long, string_count long, frame_length long, frame_count long, page_size long, page_count long, file_bytes long, problem string"
RANK_SCALE, RANK_BIAS = 28, 1 << 255


def rank_text(s: Schema, key) -> str:
    """A key as text that sorts as the key does."""
    f = s.key
    if f.is_decimal:
        value = int(key.scaleb(RANK_SCALE))
    elif f.family == Family.FLOAT:
        value = float_order(key, f.length)
    else:
        value = int(key)
    return f"{value + RANK_BIAS:064x}"


def _file_rows(key_index: int):
    def run(batches):
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                f, p = open_fs(path)
                size = f.get_file_info(p).size
                try:
                    o = open_file(path, key_index, exact=False)
                except FormatError as e:
                    out.append((path, None, *[None] * 9, size, str(e)))
                    continue
                s = o.schema
                want = o.first_frame + o.frame_count * s.frame_length if o.version == 1 else L.HEADER_2 + o.page_count * o.page_size
                out.append((path, o.version, o.title, s.frame_type, s.key.name, len(s.fields), len(o.strings), s.frame_length, o.frame_count, o.page_size, o.page_count, size, None if size == want else f"length {size}, not {want}"))
            yield _batch(out, FILE_FACTS)

    return run


def _batch(rows: list[tuple], ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def file_facts(spark: SparkSession, paths: str | list[str], key_index: int = 0) -> DataFrame:
    """One row for each file: its header and its length; problem says what is wrong with either."""
    found = [(p,) for p in discover(paths)]
    df = spark.createDataFrame(found, "path string")
    return (df.repartition(max(1, min(len(found), 200))) if found else df).mapInArrow(_file_rows(key_index), FILE_FACTS)


def _page_rows(key_index: int, deep: bool):
    codecs, encodings = {v: k for k, v in CODECS.items()}, {v: k for k, v in ENCODINGS.items()}

    def one(o, i: int) -> tuple:
        s = o.schema
        raw = read_bytes(o.path, L.HEADER_2 + i * o.page_size, o.page_size if deep else L.PAGE_HEADER)
        try:
            page = L.read_page_header(s, raw)
            problem = None
            if deep:
                order = _order(s, L.read_page(s, raw)[1])
                problem = "keys out of order" if (order[1:] < order[:-1]).any() else None
        except FormatError as e:
            return (o.path, i, 2, *[None] * 11, str(e))
        return (o.path, i, 2, codecs.get(page.codec), encodings.get(page.encoding), page.frame_count, page.size, page.stored, o.page_size - L.PAGE_HEADER - page.stored, page.first_index, str(page.first_key), str(page.last_key), rank_text(s, page.first_key), rank_text(s, page.last_key), problem)

    def chunk(o, i: int, start: int, end: int) -> tuple:
        import numpy as np

        from ..functions.keys import decode_key

        s, width = o.schema, o.schema.frame_length
        raw = read_bytes(o.path, o.first_frame + start * width, (end - start) * width)
        if len(raw) != (end - start) * width:
            return (o.path, i, 1, *[None] * 11, "frames are missing")
        frames = np.frombuffer(raw, record_type(s))
        order = _order(s, frames)
        first, last = (decode_key(s.key, frames[s.key.name][j : j + 1].tobytes()) for j in (0, len(frames) - 1))
        problem = "keys out of order" if deep and (order[1:] < order[:-1]).any() else None
        return (o.path, i, 1, None, "row-raw", len(frames), len(raw), len(raw), 0, start, str(first), str(last), rank_text(s, first), rank_text(s, last), problem)

    def run(batches):
        for b in batches:
            out = []
            for path, lo, hi in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                o = open_file(path, key_index, exact=False)
                step = max(1, TASK_BYTES // o.schema.frame_length)
                for i in range(lo, hi):
                    out.append(one(o, i) if o.version == 2 else chunk(o, i, i * step, min((i + 1) * step, o.frame_count)))
            yield _batch(out, PAGE_FACTS)

    return run


def page_facts(spark: SparkSession, paths: str | list[str], key_index: int = 0, deep: bool = False) -> DataFrame:
    """One row for each page (of version 1, for each TASK_BYTES of frames); deep reads and checks what is in it.

    Files are opened on the executors; a file that cannot be opened has no pages.
    """
    files = file_facts(spark, paths, key_index).where("version is not null")
    chunks = F.ceil(F.col("frame_count") / F.greatest(F.lit(1), F.floor(F.lit(TASK_BYTES) / F.col("frame_length"))))
    pages = F.when(F.col("version") == 1, chunks).otherwise(F.col("page_count")).cast("long")
    step = F.when(F.col("version") == 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(TASK_BYTES) / F.col("page_size")))).cast("long")
    spans = files.select("path", pages.alias("pages"), step.alias("step")).where("pages > 0")
    spans = spans.select("path", "pages", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1, F.col("step"))).alias("lo"))
    spans = spans.select("path", "lo", F.least(F.col("lo") + F.col("step"), F.col("pages")).alias("hi"))
    return spans.repartition("path", "lo").mapInArrow(_page_rows(key_index, deep), PAGE_FACTS)


def page_summary(pages: DataFrame) -> DataFrame:
    """Of each file: pages, frames, bytes, padding, and how many pages each codec and encoding has."""
    t = pages.groupBy("path").agg(
        F.count("*").alias("page_count"), F.sum("frame_count").alias("frame_count"), F.min("frame_count").alias("min_frames"), F.max("frame_count").alias("max_frames"),
        F.sum("payload_bytes").alias("payload_bytes"), F.sum("stored_bytes").alias("stored_bytes"), F.sum("padding").alias("padding"),
        *[F.count_if(F.col("codec").eqNullSafe(c)).alias(f"codec_{c}") for c in CODECS], *[F.count_if(F.col("encoding").eqNullSafe(e)).alias(f"encoding_{e.replace('-', '_')}") for e in ENCODINGS],
    )
    return t.withColumn("payload_ratio", F.try_divide("stored_bytes", "payload_bytes"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """Maximal runs of consecutive pages of one file with one codec and encoding."""
    w = Window.partitionBy("path").orderBy("page")
    same = F.col("codec").eqNullSafe(F.lag("codec").over(w)) & F.col("encoding").eqNullSafe(F.lag("encoding").over(w)) & F.lag("page").over(w).isNotNull()
    t = pages.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("path", "run").agg(
        F.max("codec").alias("codec"), F.max("encoding").alias("encoding"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum("frame_count").alias("frame_count"),
        F.min_by("first_key", "page").alias("first_key"), F.max_by("last_key", "page").alias("last_key"),
    )


def verify_files(spark: SparkSession, paths: str | list[str], key_index: int = 0) -> DataFrame:
    """One row for each file, (path, frame_count, problem): header, length, checksums, contiguous pages, key order, total.

    Pages are read by as many tasks as there are; only a row for each page is compared with the one before.
    """
    files = file_facts(spark, paths, key_index)
    w = Window.partitionBy("path").orderBy("page")
    t = page_facts(spark, paths, key_index, deep=True)
    expected = F.coalesce(F.lag(F.col("first_frame_index") + F.col("frame_count")).over(w), F.lit(0))
    t = t.withColumn("_contiguous", F.col("first_frame_index") == expected).withColumn("_ordered", F.coalesce(F.col("first_rank") >= F.lag("last_rank").over(w), F.lit(True)))
    wrong = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~F.col("_contiguous"), "pages are not contiguous").when(~F.col("_ordered"), "keys out of order")
    found = t.withColumn("_wrong", F.when(wrong.isNotNull(), F.format_string("page %d: %s", "page", wrong)))
    found = found.groupBy("path").agg(F.sum("frame_count").alias("_frames"), F.min_by("_wrong", F.when(F.col("_wrong").isNotNull(), F.col("page"))).alias("_wrong"))
    out = files.join(found, "path", "left").withColumn("_frames", F.coalesce("_frames", F.lit(0)))
    total = F.when(F.col("_frames") != F.col("frame_count"), "frame count")
    return out.select("path", F.col("_frames").alias("frame_count"), F.coalesce("problem", "_wrong", total).alias("problem"))


def light_verify(spark: SparkSession, paths: str | list[str], key_index: int = 0) -> DataFrame:
    """One row for each file, (path, problem): header, exact length and, of version 2, the last page's header."""

    def run(batches):
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                problem = None
                try:
                    o = open_file(path, key_index)
                    if o.version == 2 and o.page_count:
                        p = L.read_page_header(o.schema, read_bytes(path, L.HEADER_2 + (o.page_count - 1) * o.page_size, L.PAGE_HEADER))
                        problem = None if p.first_index + p.frame_count == o.frame_count else "frame count"
                except FormatError as e:
                    problem = str(e)
                out.append((path, problem))
            yield _batch(out, "path string, problem string")

    found = [(p,) for p in discover(paths)]
    df = spark.createDataFrame(found, "path string")
    return (df.repartition(max(1, min(len(found), 200))) if found else df).mapInArrow(run, "path string, problem string")
