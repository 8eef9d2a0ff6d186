"""Queries over binary files, stores, streams and typed rows: each writes the driver's tables and reads them back."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Annotated

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import typed
from .catalog import E_HIGH, E_SQL, JAN, cents, events, load, numbered, query
from .dataset import FrameDataset
from .plans.ordering import INDEX, checkpoint_folder
from .sources import datasource as ds
from .sources import facts
from .sources import frames as fr
from .sources import layouts as lay
from .sources.store import Store
from .streaming.append import append_stream
from .typed import Col
from .types import Schema

#: Names and titles that both layouts can hold.
DEAL = Schema.parse("Deal", "okey:i:8,ckey:i:4,status:utf8:1,cents:i:8:fixed-2,price:f:16,share:f:8,prio:sidx:1", 0)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_DEALS = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS frame_index, o_orderkey AS okey, CAST(o_custkey AS INTEGER) AS ckey, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS price, CAST(o_custkey AS DOUBLE) / 4 AS share, o_orderpriority AS prio FROM orders)"
_COLUMNS = "okey, ckey, status, cents, price, share, prio"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where the session keeps its checkpoints, which all its machines share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def deals(spark: SparkSession, sf_dir: str) -> FrameDataset:
    value = cents("o_totalprice")
    df = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").cast("int").alias("ckey"), F.col("o_orderstatus").alias("status"), value.alias("cents"), (value.cast("decimal(28,0)") / 100).cast("decimal(28,2)").alias("price"), (F.col("o_custkey") / 4).alias("share"), F.col("o_orderpriority").alias("prio"))
    return FrameDataset(df, DEAL, "deals", PRIORITIES)


def shown(d: FrameDataset) -> DataFrame:
    """The price as its digits: its scale is the file's."""
    return numbered(d.df, "okey", "ckey", "status", "cents", F.format_string("%s", (F.col("price") * 100).cast("decimal(38,0)")).alias("price"), "share", "prio")


def _round_trip(name: str, version: int, **options) -> None:
    @query(name, f"SELECT frame_index, {_COLUMNS} FROM {_DEALS}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = folder(spark, name)
        ds.save(deals(spark, sf_dir), path, version, files=3, **options)
        return shown(ds.load(spark, path))


_round_trip("binary_v1_roundtrip", 1)
_round_trip("binary_v2_roundtrip", 2)
_round_trip("binary_v2_row_lz4", 2, codec="lz4", encoding="row-raw", page_size=8192)
_round_trip("binary_v2_delta_zstd", 2, encoding="columnar-delta", page_size=16384, level=3)
_round_trip("binary_v2_plain_estimate", 2, codec="uncompressed", packing="estimate", page_size=4096)
_round_trip("binary_v2_smallest", 2, codec="smallest", encoding="smallest", page_size=65536)


@query("convert_v1_v2", f"SELECT frame_index, {_COLUMNS} FROM {_DEALS}")
def _convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (folder(spark, x) for x in ("old", "new", "again"))
    ds.save(deals(spark, sf_dir), a, 1)
    ds.convert(spark, a, b, 2, page_size=8192)
    ds.convert(spark, b, c, 1)
    return shown(ds.load(spark, c))


@query("binary_projection", f"SELECT frame_index, cents, status FROM {_DEALS}")
def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "projection")
    ds.save(deals(spark, sf_dir), path, 2, page_size=8192)
    return numbered(ds.load(spark, path, columns="cents,status").df, "cents", "status")


@query("binary_key_range", f"SELECT frame_index, okey, cents FROM {_DEALS} WHERE okey BETWEEN 100 AND 900")
def _key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "range")
    ds.save(deals(spark, sf_dir), path, 2, page_size=4096)
    d = ds.load(spark, path, low="100", high="900", columns="okey,cents")  # whole pages, by their zone maps
    return numbered(d.df.where(F.col("okey").between(100, 900)), "okey", "cents")


@query("string_codes", f"SELECT okey, CAST(substr(prio, 1, 1) AS INTEGER) - 1 AS code FROM {_DEALS}")
def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "codes")
    ds.save(deals(spark, sf_dir), path, 1)
    return ds.load(spark, path, strings="code", columns="okey,prio").df.select("okey", F.col("prio").cast("int").alias("code"))


@query("file_facts", f"SELECT v.version, 'deals' AS title, 'Deal' AS frame_type, 'okey' AS key_field, 7::BIGINT AS field_count, 5::BIGINT AS string_count, {DEAL.frame_length}::BIGINT AS frame_length, (SELECT count(*) FROM orders) AS frame_count FROM (VALUES (1), (2)) v(version)")
def _file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [folder(spark, f"facts{v}") for v in (1, 2)]
    for v, path in zip((1, 2), paths, strict=True):
        ds.save(deals(spark, sf_dir), path, v)
    return facts.file_facts(spark, paths).select("version", "title", "frame_type", "key_field", "field_count", "string_count", "frame_length", "frame_count")


@query("file_page_summary", f"SELECT frame_count, min(okey) AS first_key, max(okey) AS last_key, CAST(frame_count * {DEAL.frame_length} AS BIGINT) AS payload_bytes, 0::BIGINT AS other_codecs, true AS tiled FROM (SELECT okey, count(*) OVER () AS frame_count FROM {_DEALS}) GROUP BY frame_count")
def _page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone maps of a file: they tile it, hold its key range, and count its codecs."""
    path = folder(spark, "pages")
    ds.save(deals(spark, sf_dir), path, 2, page_size=4096, codec="lz4")
    pages = facts.page_facts(spark, path)
    ends = pages.groupBy("path").agg(F.min_by("first_key", "page").cast("long").alias("first_key"), F.max_by("last_key", "page").cast("long").alias("last_key"), (F.max(F.col("first_frame_index") + F.col("frame_count")) == F.sum("frame_count")).alias("tiled"))
    t = facts.page_summary(pages).join(ends, "path")
    return t.select("frame_count", "first_key", "last_key", "payload_bytes", (F.col("page_count") - F.col("codec_lz4")).alias("other_codecs"), "tiled")


@query("file_page_ranges", f"SELECT 'zstd' AS codec, 'columnar-delta' AS encoding, 0::BIGINT AS first_page, count(*) AS frame_count, CAST(min(okey) AS VARCHAR) AS first_key, CAST(max(okey) AS VARCHAR) AS last_key FROM {_DEALS}")
def _page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "runs")
    ds.save(deals(spark, sf_dir), path, 2, page_size=4096, encoding="columnar-delta")
    return facts.page_ranges(facts.page_facts(spark, path)).drop("path", "run", "last_page")


@query("verify_files", "SELECT version, (SELECT count(*) FROM orders) AS frame_count, CAST(NULL AS VARCHAR) AS problem FROM (VALUES (1), (2)) v(version)")
def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [folder(spark, f"sound{v}") for v in (1, 2)]
    for v, path in zip((1, 2), paths, strict=True):
        ds.save(deals(spark, sf_dir), path, v, **({"page_size": 4096} if v == 2 else {}))
    return facts.verify_files(spark, paths).select(F.when(F.col("path").contains("sound1"), 1).otherwise(2).alias("version"), "frame_count", "problem")


@query("light_verify", "SELECT version, CAST(NULL AS VARCHAR) AS problem FROM (VALUES (1), (2)) v(version)")
def _light(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [folder(spark, f"light{v}") for v in (1, 2)]
    for v, path in zip((1, 2), paths, strict=True):
        ds.save(deals(spark, sf_dir), path, v)
    return facts.light_verify(spark, paths).select(F.when(F.col("path").contains("light1"), 1).otherwise(2).alias("version"), "problem")


def _with_tail(raw: bytes, schema: Schema) -> bytes:
    """A file of version 1 with one frame that was not committed, and a torn one."""
    last = raw[-schema.frame_length :]
    return raw + last + b"torn"


def _change(path: str, change) -> None:
    f, p = ds.open_fs(path)
    with f.open_input_file(p) as h:
        raw = h.read()
    with f.open_output_stream(p) as h:
        h.write(change(raw))


@query("repair_v1", f"SELECT okey, count(*) + CASE WHEN okey = (SELECT max(okey) FROM {_DEALS}) THEN 1 ELSE 0 END AS n FROM {_DEALS} GROUP BY okey")
def _repair_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole frame after the committed ones is adopted, a torn one goes."""
    path = folder(spark, "tail")
    ds.save(deals(spark, sf_dir), path, 1)
    (file,) = ds.discover(path)
    _change(file, lambda raw: _with_tail(raw, DEAL))
    ds.repair_file(file)
    return ds.load(spark, path).df.groupBy("okey").agg(F.count("*").alias("n"))


@query("repair_v2", "SELECT true AS shorter, true AS prefix, CAST(NULL AS VARCHAR) AS problem")
def _repair_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages before a damaged one stay."""
    path = folder(spark, "torn")
    d = deals(spark, sf_dir)
    ds.save(d, path, 2, page_size=1024)
    (file,) = ds.discover(path)
    at = lay.HEADER_2 + 2 * 1024 + lay.PAGE_HEADER
    _change(file, lambda raw: raw[:at] + bytes(x ^ 255 for x in raw[at : at + 8]) + raw[at + 8 :])
    n = ds.repair_file(file)
    kept, whole = ds.load(spark, path).df, d.numbered().df.where(F.col(INDEX) < n)
    same = kept.select("okey", INDEX).exceptAll(whole.select("okey", INDEX)).isEmpty() and kept.count() == n
    return facts.verify_files(spark, path).select((F.lit(0 < n) & (F.lit(n) < F.lit(d.df.count()))).alias("shorter"), F.lit(same).alias("prefix"), "problem")


@query("codec_matrix", "SELECT codec, encoding, (SELECT count(*) FROM orders) AS frame_count FROM (VALUES ('uncompressed'), ('zstd'), ('lz4')) a(codec), (VALUES ('row-raw'), ('columnar-basic'), ('columnar-delta')) b(encoding)")
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every codec with every encoding: each file's pages say so and hold every frame."""
    top = folder(spark, "matrix")
    paths = []
    for c in fr.CODECS:
        for e in fr.ENCODINGS:
            paths.append(f"{top}/{c}-{e}")
            ds.save(deals(spark, sf_dir), paths[-1], 2, codec=c, encoding=e, page_size=65536)
    return facts.page_facts(spark, paths, deep=True).where("problem is null").groupBy("codec", "encoding").agg(F.sum("frame_count").alias("frame_count"))


# ---- stores and streams

_EVENTS = f"SELECT k, event_id, user_id, event_type FROM {E_SQL}"


def _stored(spark: SparkSession, d: FrameDataset) -> Store:
    store = Store(spark, folder(spark, "store"))
    store.create(d)
    return store


@query("store_roundtrip", _EVENTS)
def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, events(spark, sf_dir)).dataset().frames()


@query("store_append", f"SELECT 'frames' AS fact, count(*) AS value FROM {E_SQL} UNION ALL SELECT 'high_water', max(k) FROM {E_SQL} UNION ALL SELECT 'folders', 1")
def _store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store made of one half, to which the other is appended, then compacted; from its header alone."""
    d = events(spark, sf_dir)
    store = _stored(spark, d.of(d.df.where(F.col("k") < E_HIGH)))
    store.append(d.df.where(F.col("k") >= E_HIGH), ["k"])
    store.compact()
    h = store.header()
    return spark.createDataFrame([("frames", h["frame_count"]), ("high_water", h["high_water"]), ("folders", len(h["folders"]))], "fact string, value long")


@query("stream_append_invariance", f"SELECT cut, k, event_id, user_id, event_type FROM {E_SQL}, (VALUES (1), (3)) c(cut)")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as one micro-batch, and as three in two runs with a compaction between: the same frames."""
    d, out = events(spark, sf_dir), None
    empty = d.of(d.df.limit(0))
    mid = JAN + (E_HIGH - JAN) // 2
    thirds = [F.col("k") < mid, (F.col("k") >= mid) & (F.col("k") < E_HIGH), F.col("k") >= E_HIGH]
    for cut, runs in ((1, [[F.lit(True)]]), (3, [thirds[:1], thirds[1:]])):
        store, src, log = _stored(spark, empty), folder(spark, "in"), folder(spark, "log")
        for run in runs:
            for part in run:
                d.df.where(part).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(d.df.schema).option("maxFilesPerTrigger", 1).parquet(src)
            append_stream(stream, store, ["k"], log).awaitTermination()
            if run is not runs[-1]:
                store.compact()
        t = store.dataset().frames().select(F.lit(cut).alias("cut"), "*")
        out = t if out is None else out.unionByName(t)
    return out


@query("stream_late_dropped", f"SELECT 'kept' AS part, count(*) AS n FROM {E_SQL} WHERE k >= {E_HIGH} UNION ALL SELECT 'dead', count(*) FROM {E_SQL} WHERE k < {E_HIGH}")
def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events first: those that come late go to the dead-letter table."""
    d = events(spark, sf_dir)
    store, src = _stored(spark, d.of(d.df.limit(0))), folder(spark, "in")
    for part in (F.col("k") >= E_HIGH, F.col("k") < E_HIGH):
        d.df.where(part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(d.df.schema).parquet(src)
        append_stream(stream, store, ["k"], f"{src}-log", late="drop").awaitTermination()
    kept, dead = store.dataset().df, spark.read.parquet(f"{store.path}/dead")
    return kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n")).union(dead.agg(F.lit("dead"), F.count("*")))


# ---- typed rows


@dataclass
class NationRow:
    n_nationkey: Annotated[int, Col("i:4", key=True)]
    n_regionkey: Annotated[int, Col("i:4")]
    n_name: Annotated[str, Col("utf8:25")]


@query("typed_roundtrip", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, CAST(n_regionkey AS INTEGER) AS n_regionkey, n_name FROM nation")
def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as instances, through a binary file, and back as instances."""
    rows = [NationRow(r.n_nationkey, r.n_regionkey, r.n_name) for r in load(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a table of fixed size
    path = folder(spark, "typed")
    ds.save(typed.dataset_of(spark, NationRow, rows, "nations"), path, 2)
    back = list(typed.rows_of(ds.load(spark, path), NationRow))
    return spark.createDataFrame([(r.n_nationkey, r.n_regionkey, r.n_name) for r in back], "n_nationkey int, n_regionkey int, n_name string")
