import itertools

import pytest
from pyspark.sql import functions as F

from keyframe.dataset import FrameDataset
from keyframe.errors import IncompatibleError, KeyOrderError, RangeError, StringTableError
from keyframe.operators import maintain, mutate, organize, pages, read, strings
from keyframe.plans import ordering
from keyframe.types import Schema

PAIR = Schema.parse("Tick", "Time:i:4,Value:u:4")


def make(spark, keys, schema=PAIR, title="t", table=()):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "Time int, Value long")
    return FrameDataset(df, schema, title, tuple(table), ("Value",))


@pytest.fixture(scope="module")
def b1(spark):
    """300 frames: key 1 x 40, 2 x 140, 3 x 80, 5 x 40."""
    return make(spark, [1] * 40 + [2] * 140 + [3] * 80 + [5] * 40)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_bounds(b1):
    assert read.lower_bound(b1, 2).first()[0] == 40 and read.upper_bound(b1, 2).first()[0] == 180
    assert tuple(read.equal_range(b1, 2).first()) == (40, 180) and tuple(read.equal_range(b1, 4).first()) == (260, 260)
    assert rows(read.equal_ranges(b1, [0, 1, 9]), "key", "start_idx", "end_idx") == [(0, 0, 0), (1, 0, 40), (9, 300, 300)]
    assert read.frames_between(b1, 2, 3).count() == 220 and read.frames_between(b1, 3, 2).count() == 0
    assert read.frames_by_keys(b1, [1, 2, 2, 4, 5]).count() == 220
    with pytest.raises(KeyOrderError):
        read.frames_by_keys(b1, [2, 1])


def test_float_keys(spark):
    s = Schema.parse("F", "Time:f:8,Value:u:4")
    d = FrameDataset(spark.createDataFrame([(-1.5, 0), (-0.0, 1), (0.0, 2), (0.0, 3), (2.25, 4)], "Time double, Value long"), s, "f", (), ("Value",))
    assert tuple(read.equal_range(d, 0.0).first()) == (2, 4) and tuple(read.equal_range(d, -0.0).first()) == (1, 2)
    assert [r.Value for r in d.numbered().df.orderBy("_frame_index").collect()] == [0, 1, 2, 3, 4]


def test_find_and_select(spark):
    d = make(spark, range(30))
    f = read.find(d, ["18..", "2", "5..7", "..0", "6"])
    assert (f["selector_count"], f["range_count"], f["frame_count"]) == (5, 4, 17)
    assert read.find(d, ["10..12"])["ranges"] == [(10, 13)]
    assert read.select(d, ["18..", "2", "5..7", "..0", "6"]).count() == 17 and read.select(d, []).count() == 30
    empty = make(spark, [])
    assert read.find(empty, [])["range_count"] == 1 and read.find(empty, [])["frame_count"] == 0


def test_positions(b1):
    assert rows(read.frame_at(b1, 40), "Time", "Value") == [(2, 40)] and read.frame_at(b1, 300).count() == 0
    assert read.frames_chunk(b1, 290, 50).count() == 10 and read.frames_chunk(b1, 900, 5).count() == 0
    with pytest.raises(RangeError):
        read.frames_slice(b1, 290, 301)
    assert rows(read.preview(b1), "Value") == [(0,), (1,), (2,), (297,), (298,), (299,)]
    assert rows(read.boundary(b1), "Time") == [(1,)] and rows(read.boundary(b1, last=True), "Value") == [(299,)]


def test_empty(spark):
    e = make(spark, [])
    assert tuple(read.equal_range(e, 1).first()) == (0, 0) and read.boundary(e).count() == 0 and read.preview(e).count() == 0
    assert tuple(read.boundary_keys(e).first()) == (0, None, None)
    assert mutate.delete_keys(e, [1])[1] == 0


def test_large_index_equals_window(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WINDOW_ROWS", 700)
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    got = ordering.with_index(df, ["k", "id"]).collect()
    want = {r: i for i, r in enumerate(sorted((r.k, r.id) for r in got))}
    assert all(want[r.k, r.id] == r._frame_index for r in got) and len(got) == 5000


def test_deletes(spark, b1):
    ten = make(spark, range(10))
    left = lambda x: [r.Time for r in x[0].df.orderBy("Time").collect()]
    assert left(mutate.delete_indices(ten, [1, 4, 8])) == [0, 2, 3, 5, 6, 7, 9]
    assert left(mutate.delete_ranges(ten, [(1, 3), (5, 7)])) == [0, 3, 4, 7, 8, 9]
    kept, n = mutate.remove(ten, ["8..", "2", "4..5", "5", "..0"])
    assert n == 6 and [r.Time for r in kept.df.orderBy("Time").collect()] == [1, 3, 6, 7]
    assert mutate.delete_keys(b1, [1, 1, 3, 4])[1] == 120
    assert mutate.delete_key_range(b1, 3, 1)[1] == 0 and mutate.delete_before(b1, 2)[1] == 180 and mutate.delete_after(b1, 2)[1] == 260
    assert mutate.delete_frame(ten, 10)[1] is False and mutate.delete_frame(ten, 9)[1] is True
    assert mutate.delete_all(ten)[1] == 10
    for bad in ([3, 3], [2, 1], [10]):
        with pytest.raises(RangeError):
            mutate.delete_indices(ten, bad)
    with pytest.raises(RangeError):
        mutate.delete_ranges(ten, [(1, 3), (2, 4)])
    with pytest.raises(RangeError):
        mutate.remove(ten, [])


def test_editor_fixture(spark):
    d = make(spark, [12, 12, 13, 13, 14, 15, 15, 100, 100])
    d, n = mutate.delete_key_range(d, 13, 15)
    assert n == 5
    d, n = mutate.delete_key(d, 100)
    assert n == 2 and rows(d.df, "Time") == [(12,), (12,)]


def test_appends(spark):
    d = make(spark, [10])
    batch = lambda *k: spark.createDataFrame([(x, 0, i) for i, x in enumerate(k)], "Time int, Value long, seq int")
    with pytest.raises(KeyOrderError) as e:
        mutate.append_transactional(d, batch(11, 13, 12), "seq")
    assert (e.value.key, e.value.previous) == (12, 13)
    assert rows(mutate.append_transactional(d, batch(11, 12), "seq").df, "Time") == [(10,), (11,), (12,)]
    assert mutate.append_presorted(d, batch(10, 9), "seq").df.count() == 3
    with pytest.raises(KeyOrderError):
        mutate.append_presorted(d, batch(9, 10), "seq")


def test_split_concat(spark, b1):
    assert rows(organize.split_counts(b1, [2, 3]), "part", "frame_count") == [(0, 40), (1, 140), (2, 120)]
    assert rows(organize.split_counts(b1, [2, 2, 3], keep_empty=True), "part", "frame_count") == [(0, 40), (1, 0), (2, 140), (3, 120)]
    assert rows(organize.split_counts(b1, [0, 3]), "part", "frame_count") == [(0, 180), (1, 120)]
    found = organize.parts(b1, [2, 3])
    assert rows(organize.concat(found).df, "Time", "Value") == rows(b1.df, "Time", "Value")
    with pytest.raises(KeyOrderError):
        organize.concat(found[::-1])
    with pytest.raises(KeyOrderError):
        organize.split(b1, [3, 2])
    with pytest.raises(IncompatibleError):
        organize.concat([])
    with pytest.raises(IncompatibleError):
        organize.concat([b1, mutate.set_title(b1, "other")])


def test_mixed_concat_keeps_semantics(spark):
    a, b = make(spark, range(30)), make(spark, range(30, 70), PAIR.with_semantics({"Time": "unix-seconds"}))
    with pytest.raises(IncompatibleError):
        organize.concat([a, b])
    out = organize.concat([a, b], strict=False)
    assert out.df.count() == 70 and out.schema.key.semantic.kind == "unix-seconds"


def test_strings(spark):
    d = make(spark, [], table=("alpha", "beta", "alpha"))
    assert strings.index_of(d, "alpha") == 2 and strings.index_of(d, "x") is None
    assert strings.merge([("a",), ("a", "b"), ()]) == ("a", "b")
    with pytest.raises(StringTableError):
        strings.merge([("a",), ("b", "c")])
    assert strings.append_string(d, "z")[1] == 3 and strings.clear_strings(d).strings == ()
    t = strings.as_table(spark, d.strings)
    assert rows(strings.reverse(t), "value", "idx") == [("alpha", 2), ("beta", 1)]
    codes = spark.createDataFrame([(0,), (7,)], "code long")
    assert rows(strings.decode(codes.where("code = 0"), t, "code", "s"), "s") == [("alpha",)]
    with pytest.raises(Exception, match="no string at index 7"):
        strings.decode(codes, t, "code", "s").collect()


def test_pages(spark):
    d = make(spark, [1] * 50 + [2] * 400 + [3] * 50)
    z = pages.zone_map(d, 64, F.col("Time"))
    assert pages.page_stats(z).first().page_count == 8 and maintain.light_verify(500, z)
    assert maintain.contiguity_violations(z).count() == 0
    assert rows(pages.page_for_index(z, 64), "page_id") == [(1,)] and pages.page_for_index(z, 500).count() == 0
    assert rows(pages.page_for_key(z, 2), "page_id") == [(0,)] and pages.page_for_key(z, 9).count() == 0
    assert [r.label for r in pages.page_runs(z).orderBy("first_page").collect()] == [2, 3]
    back = pages.delta_decode(pages.delta_encode(d, 64, "Value", 8), 8)
    assert back.where("((Value + 128) % 256) - 128 <> value").count() == 0


def test_verify_repair(spark):
    df = spark.createDataFrame([(k, i, i) for i, k in enumerate([1, 2, 5, 4, 6])], "Time int, Value long, _frame_index long")
    d = FrameDataset(df, PAIR, "t")
    assert not maintain.verify(d) and rows(maintain.order_violations(d), "Time", "previous_key") == [(4, 5)]
    assert rows(maintain.repair(d).df, "Time") == [(1,), (2,), (5,)]
    found, errors = maintain.ls({"a": d, "b": None})
    assert found.first().frame_count == 5 and list(errors) == ["b"]


def test_header_edits(spark):
    d = make(spark, range(3))
    r = mutate.rename(d, {"Time": "When"})
    assert r.df.columns[0] == "When" and r.schema.key.name == "When"
    s = mutate.set_semantics(d, {"Time": "unix-milliseconds"})
    assert s.df.schema["Time"].metadata["semantic"] == "unix-milliseconds"
    assert mutate.set_frame_type(d, "X").schema.frame_type == "X"


def test_split_concat_identity_random(spark):
    import random

    r = random.Random(3)
    d = make(spark, sorted(r.choices(range(20), k=200)))
    for n in (1, 4):
        cuts = sorted(r.choices(range(-2, 25), k=n))
        assert rows(organize.concat(organize.parts(d, cuts)).df, "Time", "Value") == rows(d.df, "Time", "Value")
    for a, b in itertools.product((3, 9), (9, 15)):
        kept, gone = mutate.delete_key_range(d, a, b)
        assert kept.df.count() + gone == 200 and gone == read.frames_between(d, a, b).count()
