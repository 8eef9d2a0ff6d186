import json
import os
from dataclasses import dataclass
from decimal import Decimal
from typing import Annotated

import numpy as np
import pytest

from keyframe import cli, typed
from keyframe.dataset import FrameDataset
from keyframe.errors import FormatError, HeaderError, KeyOrderError, KeyValueError, LengthError, PageError, RangeError, SchemaError, StringTableError
from keyframe.operators import read
from keyframe.sources import datasource as ds
from keyframe.sources import frames as fr
from keyframe.sources import layouts as lay
from keyframe.sources.store import Store
from keyframe.streaming.append import append_stream
from keyframe.typed import Col
from keyframe.types import Schema

ALL = Schema.parse("All", "i1:i:1,i2:i:2,i4:i:4,i8:i:8,u1:u:1,u2:u:2,u4:u:4,u8:u:8,f4:f:4,f8:f:8,s5:utf8:5,d:f:16,x1:sidx:1,x8:sidx:8", 2)
TICK = Schema.parse("Tick", "Time:i:4,Value:f:8,Str:utf8:4")


def columns(n):
    return {
        "i1": [i % 256 - 128 for i in range(n)], "i2": [i - 300 for i in range(n)], "i4": [i // 3 for i in range(n)], "i8": [-(2**63) + i for i in range(n)], "u1": [i % 256 for i in range(n)], "u2": [65535 - i for i in range(n)], "u4": [2**32 - 1 - i for i in range(n)],
        "u8": [Decimal(2**64 - 1 - i) for i in range(n)], "f4": [i / 4 for i in range(n)], "f8": [i / 3 for i in range(n)], "s5": [f"é{i % 10}" for i in range(n)], "d": [Decimal(i) / 100 for i in range(n)], "x1": ["AAPL", "MSFT"] * (n // 2), "x8": ["MSFT"] * n,
    }


@pytest.mark.parametrize("codec", fr.CODECS)
@pytest.mark.parametrize("encoding", fr.ENCODINGS.values())
def test_pages_round_trip(codec, encoding):
    strings = ("MSFT", "AAPL")
    frames = fr.encode_columns(ALL, columns(600), strings)
    raw = lay.write_file_2(ALL, "t", strings, frames, 4096, codec, encoding)
    h = lay.read_header_2(raw)
    assert (h.schema, h.title, h.strings, h.frame_count) == (ALL, "t", strings, 600)
    pages = [lay.read_page(ALL, raw[lay.HEADER_2 + i * 4096 :][:4096]) for i in range(h.page_count)]
    assert np.concatenate([f for _, f in pages]).tobytes() == frames.tobytes()
    assert [p.first_index for p, _ in pages] == list(np.cumsum([0] + [p.frame_count for p, _ in pages])[:-1])
    broken = bytearray(raw[lay.HEADER_2 :][:4096])
    broken[lay.PAGE_HEADER + 3] ^= 1
    with pytest.raises(FormatError):
        lay.read_page(ALL, bytes(broken))


def test_values_survive():
    got = fr.decode_columns(ALL, fr.encode_columns(ALL, columns(300), ("MSFT", "AAPL")), ("MSFT", "AAPL"))
    want = columns(300)
    assert all([Decimal(x) if isinstance(x, Decimal) else x for x in got[k]] == want[k] for k in want if k != "f4")
    with pytest.raises(StringTableError):
        fr.decode_columns(ALL, fr.encode_columns(ALL, columns(4), ("MSFT", "AAPL")), ("MSFT",))
    with pytest.raises(KeyValueError):
        fr.encode_columns(TICK, {"Time": [2**31], "Value": [0.0], "Str": [""]})
    with pytest.raises(KeyValueError):
        fr.encode_columns(TICK, {"Time": [0], "Value": [0.0], "Str": ["ééé"]})


def test_decode_rejects():
    s = Schema.parse("T", "k:i:4")
    with pytest.raises(FormatError):
        fr.decode_payload(s, bytes([2]) + bytes(8), 2, fr.DELTA)
    with pytest.raises(FormatError):
        fr.decode_payload(s, bytes(7), 2, fr.COLUMNAR)
    with pytest.raises(FormatError):
        fr.decode_payload(s, bytes(9), 2, fr.COLUMNAR)


def test_version_1_limits_and_strings():
    strings = ("", "a" * 200, "é")
    assert lay.read_strings_1(lay.write_strings_1(strings), 3) == strings
    with pytest.raises(FormatError):
        lay.read_strings_1(lay.write_strings_1(strings) + b"x", 3)
    with pytest.raises(SchemaError):
        lay.write_header_1(lay.Header1(Schema.parse("T", "toolongname:i:4"), "t", 0))
    h = lay.Header1(TICK, "title", 7, 2, 9)
    assert lay.read_header_1(lay.write_header_1(h)) == h
    with pytest.raises(HeaderError):
        lay.detect(b"nope")


def dataset(spark, n=3000):
    df = spark.createDataFrame([(i // 2, i * 0.5, f"s{i % 9}") for i in range(n)], "Time int, Value double, Str string")
    return FrameDataset(df, TICK, "ticks", ("x",), ("Value",))


@pytest.mark.parametrize("version,options", [(1, {}), (2, {"codec": "zstd", "page_size": 4096}), (2, {"codec": "lz4", "encoding": "columnar-delta", "page_size": 2048})])
def test_data_source(spark, tmp_path, version, options):
    path = str(tmp_path / "set")
    d = dataset(spark)
    ds.save(d, path, version, files=3, **options)
    back = ds.load(spark, path)
    assert back.title == "ticks" and back.strings == ("x",)
    got = [tuple(r) for r in back.df.orderBy("_frame_index").collect()]
    assert [g[1:] for g in got] == [tuple(r) for r in d.df.orderBy("Value").collect()] and [g[0] for g in got] == list(range(3000))
    some = ds.load(spark, path, columns="Value", low="100", high="110").df if version == 2 else None
    if some is not None:
        assert some.columns == ["_frame_index", "Value"] and 22 <= some.count() < 3000
    assert sum(map(ds.verify_file, ds.discover(path))) == 3000
    assert tuple(read.equal_range(back, 7).first()) == (14, 16)


def test_repair(spark, tmp_path):
    path = str(tmp_path / "one")
    ds.save(dataset(spark, 500), path, 1)
    (f,) = ds.discover(path)
    with open(f, "ab") as h:
        h.write(fr.encode_columns(TICK, {"Time": [400, 1], "Value": [0.0, 0.0], "Str": ["", ""]}).tobytes() + b"xyz")
    with pytest.raises(LengthError):
        ds.open_file(f)
    assert ds.repair_file(f) == 501 and ds.verify_file(f) == 501
    path = str(tmp_path / "two")
    ds.save(dataset(spark, 500), path, 2, page_size=1024, codec="uncompressed")
    (f,) = ds.discover(path)
    assert ds.open_file(f).page_count > 4
    with open(f, "r+b") as h:
        h.seek(lay.HEADER_2 + 3 * 1024 + 100)
        h.write(b"\xff\xfe\xfd")
    with pytest.raises(PageError, match="page 3"):
        ds.verify_file(f)
    n = ds.repair_file(f)
    assert 0 < n < 500 and ds.verify_file(f) == n


def test_store_and_stream(spark, tmp_path):
    """A stream cut in any way, and resumed, leaves the same frames; late keys fail or are set aside."""
    rows = [(i // 3, float(i), "a") for i in range(90)]
    results = []
    for cut in (90, 30, 9):
        src, store = str(tmp_path / f"in{cut}"), Store(spark, str(tmp_path / f"store{cut}"))
        store.create(FrameDataset(spark.createDataFrame([], TICK.spark_schema()), TICK, "t", (), ("Value",)))
        for a in range(0, 90, cut):
            spark.createDataFrame(rows[a : a + cut], "Time int, Value double, Str string").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema("Time int, Value double, Str string").parquet(src)
            append_stream(stream, store, ["Time", "Value"], str(tmp_path / f"check{cut}")).awaitTermination()
        results.append(sorted(map(tuple, store.dataset().frames().collect())))
        assert store.high_water() == 29
    assert results[0] == results[1] == results[2] == sorted(rows)
    late = spark.createDataFrame([(1, 0.0, "b"), (40, 1.0, "b")], "Time int, Value double, Str string")
    late.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("Time int, Value double, Str string").parquet(src)
    append_stream(stream, store, ["Time", "Value"], str(tmp_path / "check9"), late="drop").awaitTermination()
    assert store.dataset().df.count() == 91 and spark.read.parquet(store.path + "/dead").count() == 1
    store.compact()
    assert store.dataset().df.count() == 91 and store.high_water() == 40
    spark.createDataFrame([(41, 2.0, "b")], "Time int, Value double, Str string").coalesce(1).write.mode("append").parquet(src)
    append_stream(stream, store, ["Time", "Value"], str(tmp_path / "check9"), late="drop").awaitTermination()
    assert store.dataset().df.count() == 92 and store.high_water() == 41  # a batch after a compaction is not skipped
    assert store.vacuum() == 0  # a kept header still lists the folders before the compaction
    for _ in range(3):
        store.set_header(store.dataset())
    assert store.vacuum() > 0 and store.dataset().df.count() == 92
    with pytest.raises(FormatError):
        store.create(store.dataset())


def test_stream_fails_on_late_keys(spark, tmp_path):
    from keyframe.streaming.append import ordered_append

    store = Store(spark, str(tmp_path / "s"))
    store.create(dataset(spark, 20))
    batch = spark.createDataFrame([(3, 0.0, "b")], "Time int, Value double, Str string")
    with pytest.raises(KeyOrderError):
        ordered_append(store, ["Time"])(batch, 5)
    ordered_append(store, ["Time"])(batch.withColumn("Time", batch.Time + 6), 5)
    ordered_append(store, ["Time"])(batch, 5)  # a batch that was committed before is skipped
    assert store.dataset().df.count() == 21


def test_store_of_other_keys(spark, tmp_path):
    """High-water marks of float and decimal keys, and writers that meet."""
    from keyframe.errors import IncompatibleError

    for kind, column, values in (("f:8", "double", [-0.5, 1.5, float("inf")]), ("f:16", "decimal(28,4)", [Decimal("1.2500"), Decimal("3.5000"), Decimal("9.0000")])):
        s = Schema.parse("T", f"k:{kind}")
        store = Store(spark, str(tmp_path / column))
        store.create(FrameDataset(spark.createDataFrame([(values[1],)], f"k {column}"), s))
        assert store.high_water() == values[1]
        store.append(spark.createDataFrame([(values[2],)], f"k {column}"), ["k"])
        assert store.high_water() == values[2] and store.header()["frame_count"] == 2
        h = store.header()
        store._publish(h, h["number"])
        with pytest.raises(IncompatibleError):
            store._publish(h, h["number"])
    assert not Store(spark, str(tmp_path / "none")).exists()


@pytest.mark.parametrize("packing", ["tight", "estimate"])
@pytest.mark.parametrize("codec,encoding", [("smallest", "smallest"), ("zstd", 2), ("uncompressed", 0)])
def test_packing(packing, codec, encoding):
    r = np.random.default_rng(3)
    frames = fr.encode_columns(TICK, {"Time": sorted(r.integers(0, 9999, 4000).tolist()), "Value": r.normal(size=4000).round(2).tolist(), "Str": ["ab"] * 4000})
    stats = lay.Packing()
    raw = lay.write_file_2(TICK, "t", (), frames, 4096, codec, encoding, 6, packing, stats)
    h = lay.read_header_2(raw)
    pages = [lay.read_page(TICK, raw[lay.HEADER_2 + i * 4096 :][:4096]) for i in range(h.page_count)]
    assert np.concatenate([f for _, f in pages]).tobytes() == frames.tobytes() and stats.pages == h.page_count and stats.trials < 40 * stats.pages * (9 if codec == "smallest" else 1)
    if packing == "tight" and codec != "smallest":
        at = 0
        for p, _ in pages[:-1]:  # one more frame would not fit
            more = frames[at : at + p.frame_count + 1]
            assert len(fr.compress(fr.encode_payload(TICK, more, encoding), fr.CODECS[codec])) > 4096 - lay.PAGE_HEADER
            at += p.frame_count


def test_file_checks_find_faults(spark, tmp_path):
    from keyframe.sources import facts

    path = str(tmp_path / "set")
    ds.save(dataset(spark, 500), path, 2, page_size=1024, codec="uncompressed")
    assert [(r.frame_count, r.problem) for r in facts.verify_files(spark, path).collect()] == [(500, None)]
    (f,) = ds.discover(path)
    with open(f, "r+b") as h:
        h.seek(lay.HEADER_2 + 3 * 1024 + 100)
        h.write(b"\xff\xfe\xfd")
    (r,) = facts.verify_files(spark, path).collect()
    assert r.problem == "page 3: page checksum" and [x.problem for x in facts.light_verify(spark, path).collect()] == [None]
    with open(f, "ab") as h:
        h.write(b"x")
    (r,) = facts.light_verify(spark, path).collect()
    assert r.problem == "file length"
    (tmp_path / "set" / "other.frames").write_bytes(b"none of ours")
    assert ds.discover(path) == [f] and ds.discover([path, f]) == [f] and len(ds.discover(path, ".FRAMES")) == 2


@dataclass
class Quote:
    time: Annotated[int, Col("i:4", key=True)]
    price: Annotated[int, Col("u:4", semantic="fixed-2")]
    label: Annotated[str, Col("utf8:4")]
    note: Annotated[str, Col(ignore=True)] = None


def test_typed(spark):
    s = typed.schema_of(Quote)
    assert s.frame_length == 12 and s.key.name == "time" and s.fields[1].semantic.points == 2
    d = typed.dataset_of(spark, Quote, [Quote(1, 5, "a"), Quote(2, 1, "b"), Quote(2, 0, "c")])
    assert list(typed.rows_of(d, Quote)) == [Quote(1, 5, "a"), Quote(2, 1, "b"), Quote(2, 0, "c")]

    assert list(typed.rows_of(d, Quote, start=1, end=2)) == [Quote(2, 1, "b")]
    e = typed.TypedEditor(d, Quote)
    assert e.append([Quote(2, 9, "d"), Quote(7, 1, "e")]) == 2 and e.get(4) == Quote(7, 1, "e")
    with pytest.raises(KeyOrderError):
        e.append([Quote(9, 1, "f"), Quote(8, 1, "g")])
    assert e.delete(0) and e.delete_keys([7]) == 1 and e.delete_between(0, 1) == 0 and e.dataset.df.count() == 3
    with pytest.raises(RangeError):
        e.get(3)
    assert ds.chunk_rows(TICK, 4096) == 4 * (4096 - 80) // 16

    @dataclass
    class TwoKeys:
        a: Annotated[int, Col("i:4", key=True)]
        b: Annotated[int, Col("i:4", key=True)]

    @dataclass
    class Bare:
        a: int

    @dataclass
    class Odd:
        a: Annotated[int, Col("q:4", key=True)]

    @dataclass
    class Hidden:
        a: Annotated[int, Col("i:4", key=True, ignore=True)]

    for bad in (TwoKeys, Bare, Odd, Hidden, int):
        with pytest.raises(SchemaError):
            typed.schema_of(bad)
    with pytest.raises(SchemaError):
        next(typed.rows_of(dataset(spark, 2), Quote))


def test_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "set")
    ds.save(dataset(spark, 60), path, 2)
    assert cli.main(["find", path, "10..12", "5"]) == 0
    assert "frame_count = 8" in capsys.readouterr().out
    assert cli.main(["cat", path, "3", "csv"]) == 0
    assert capsys.readouterr().out.splitlines() == ["Time,Value,Str", "3,3,s6", "3,3.5,s7"]
    assert cli.main(["verify", path]) == 0 and "60 frames" in capsys.readouterr().out
    assert cli.main(["verify", "--light", path]) == 0 and "sound" in capsys.readouterr().out
    assert cli.main(["ls", path, "jsonl"]) == 0
    (row,) = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert (row["version"], row["frame_count"], row["first_key"], row["last_key"], row["string_count"]) == (2, 60, "0", "29", 1)
    for fmt, lines in (("csv", 2), ("md", 3), ("table", 2)):
        assert cli.main(["ls", path, fmt]) == 0 and len(capsys.readouterr().out.splitlines()) == lines
    assert cli.main(["inspect", path]) == 0
    out = capsys.readouterr().out
    assert "codec_zstd = 1" in out and "s5" in out
    more = str(tmp_path / "more")
    ds.save(FrameDataset(spark.createDataFrame([(29, 1.0, "z"), (50, 1.0, "z")], "Time int, Value double, Str string"), TICK, "ticks", ("x",)), more)
    assert cli.main(["append", more, path]) == 1  # keys would fall
    both = str(tmp_path / "both")
    assert cli.main(["concat", path, more, both]) == 0 and cli.main(["concat", path, more, both]) == 1
    assert cli.main(["append", path, more]) == 0 and "frame_count = 62" in capsys.readouterr().out
    assert [tuple(r)[1:] for r in ds.load(spark, path).df.orderBy("_frame_index").collect()][-2:] == [(29, 1.0, "z"), (50, 1.0, "z")]
    assert cli.main(["append", path, str(tmp_path / "odd")]) == 1
    assert cli.main(["rm", path, "--yes", "--out", str(tmp_path / "back"), "50..", "--force"]) == 0
    assert cli.main(["set", path, more, "title=new", "rename:Str=Text", "Value=none"]) == 0
    assert ds.load(spark, more + ".new").title == "new" and ds.load(spark, path + ".new").schema.names[2] == "Text"
    assert cli.main(["new", str(tmp_path / "fresh"), "--template", more]) == 0 and ds.load(spark, str(tmp_path / "fresh")).schema == TICK
    assert cli.main(["convert", path, "v1", str(tmp_path / "old")]) == 0
    assert ds.open_file(ds.discover(str(tmp_path / "old"))[0]).version == 1
    assert cli.main(["rm", path, "--yes", "--out", str(tmp_path / "less"), "0..9"]) == 0
    assert ds.load(spark, str(tmp_path / "less")).df.count() == 42
    assert cli.main(["find", path, ".."]) == 1
    assert cli.write_tokens(["smallest", "zz", "estimate-shrink"]) == ({"codec": "smallest", "encoding": "smallest", "packing": "estimate"}, ["zz"])
    assert cli.write_tokens(["zstd:9"])[0] == {"codec": "zstd", "level": 9}
    assert cli.write_tokens(["lz4", "1MiB", "x"]) == ({"codec": "lz4", "page_size": 1 << 20}, ["x"])
    for bad in (["zstd", "lz4"], ["1B"], ["smallest", "row-raw"]):
        with pytest.raises(ValueError):
            cli.write_tokens(bad)
    assert os.path.isdir(path)
