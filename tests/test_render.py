import struct

from pyspark.sql import functions as F

from keyframe.dataset import FrameDataset
from keyframe.functions import render
from keyframe.types import Field, Schema

QUOTE = Schema.parse("Quote", "time:i:8:unix-milliseconds,price:u:4,symbol:sidx:1,name:utf8:4")


def show(spark, field, value, kind="bigint"):
    f = Field.parse(field)
    return spark.sql(f"SELECT CAST({value} AS {kind}) AS v").select(render.display(f, F.col("v"))).first()[0]


# Renderings of one frame, and of numbers and times below, that must be the same everywhere.
def test_golden_frame(spark):
    df = spark.createDataFrame([(1522742400125, 5678900, "AAPL", "AB", 1)], "time long, price long, symbol string, name string, code int")
    d = FrameDataset(df, QUOTE, "q", ("MSFT", "AAPL"))
    line = lambda fmt: df.select(render.line(d, fmt, {"symbol": "code"})).first()[0]
    assert line("raw") == "1522742400125 5678900 AAPL AB"
    assert render.header(d, "csv") == ["time,price,symbol,name"] and line("csv") == "1522742400125,5678900,AAPL,AB"
    assert line("jsonl") == '{"time":1522742400125,"price":5678900,"symbol":"AAPL","name":"AB"}'
    assert line("hex") == "7d14858a6201000034a756000141422020"
    assert render.header(d, "md") == ["| time | price | symbol | name |", "| ---: | ---: | --- | --- |"]
    assert line("md") == "| 2018-04-03T08:00:00.125Z | 5678900 | AAPL | AB |"
    assert render.header(d, "table") == ["                    time       price  symbol  name"]
    assert line("table") == "2018-04-03T08:00:00.125Z     5678900  AAPL    AB"


def test_fixed_point(spark):
    assert show(spark, "a:i:8:fixed-2", -5) == "-0.05" and show(spark, "a:i:8:fixed-0", 1234567) == "1,234,567"
    assert show(spark, "a:i:8:percent-2", 123456) == "1,234.56%"
    assert show(spark, "a:i:8:fixed-8", 2**63 - 1) == "92,233,720,368.54775807"
    assert show(spark, "a:i:4:fixed-4", -(2**31)) is None and show(spark, "a:u:4:fixed-1", 0) == "0.0"


def test_hex_of_floats(spark):
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1e300, -1e-300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 3.0, 2.0**-1074 * 12345, 0.9999999999999999]
    for kind, pack, column in (("f:8", "<d", "double"), ("f:4", "<f", "float")):
        some = [v for v in values if kind == "f:8" or v in (0.0, 1.0, -1.5, 3.0, float("inf"), float("-inf"))] + ([1e-45, 1.1754943508222875e-38, 3.4028234663852886e38, 0.10000000149011612] if kind == "f:4" else [])
        s = Schema.parse("T", f"k:i:4,v:{kind}")
        d = FrameDataset(spark.createDataFrame(list(enumerate(some)), f"k int, v {column}"), s, "t")
        got = [r[0][8:] for r in d.df.orderBy("k").select(render.line(d, "hex")).collect()]
        assert got == [struct.pack(pack, v).hex() for v in some]


def test_timestamps(spark):
    assert show(spark, "a:i:8:unix-seconds", 0) == "1970-01-01T00:00:00Z"
    assert show(spark, "a:i:8:unix-milliseconds", -1) == "1969-12-31T23:59:59.999Z"
    assert show(spark, "a:i:8:unix-nanoseconds", 1) == "1970-01-01T00:00:00.000000001Z"
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert show(spark, "a:i:8:unix-microseconds", 1) == "1970-01-01T00:00:00.000001Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_floats_and_escapes(spark):
    assert show(spark, "a:f:8", 1.0, "double") == "1" and show(spark, "a:f:8", "2.5", "double") == "2.5"
    assert show(spark, "a:f:8", "'NaN'", "double") == "NaN" and show(spark, "a:f:8", "1e10", "double") == "10000000000"
    for text, want in (("1e22", "10000000000000000000000"), ("1e-20", "0.00000000000000000001"), ("-1.25e-7", "-0.000000125"), ("1.5e300", "15" + "0" * 299), ("-12345678901234567", "-12345678901234568"), ("123456789.125", "123456789.125")):
        assert show(spark, "a:f:8", text, "double") == want
    s = Schema.parse("T", "k:i:4,s:utf8:9")
    d = FrameDataset(spark.createDataFrame([(1, 'a,"b|\n')], "k int, s string"), s, "t")
    assert d.df.select(render.line(d, "csv")).first()[0] == '1,"a,""b|\n"'
    assert d.df.select(render.line(d, "jsonl")).first()[0] == '{"k":1,"s":"a,\\"b|\\n"}'
    assert d.df.select(render.line(d, "md")).first()[0] == '| 1 | a,"b\\|\n |'


def test_toml():
    assert render.toml({"a": {"x": 1, "y": 'q"', "z": True, "n": None, "l": [1, "b"]}}) == '[a]\nx = 1\ny = "q\\""\nz = true\nl = [1, "b"]\n'


def test_clean_utf8(spark):
    assert spark.sql("SELECT CAST(X'4142090000' AS BINARY) AS b").select(render.clean_utf8(F.col("b"))).first()[0] == "AB"
