"""Positions, order checks and filters: right whatever the sizes, and with plans that hold at any."""

import random
import struct
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keyframe.dataset import FrameDataset
from keyframe.operators import maintain, mutate, pages, read
from keyframe.plans import ordering
from keyframe.plans.ordering import INDEX
from keyframe.types import Schema

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small(monkeypatch):
    """Windows of a few rows, so that every way for large sets is taken."""
    monkeypatch.setattr(ordering, "WINDOW_ROWS", 40)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_micros_in_any_zone(spark, zone):
    from keyframe.catalog import micros, timestamp_literal

    times = [datetime(2024, 3, 10, 2, 30, 0, 123456), datetime(2024, 11, 3, 1, 30), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 7, 1), datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999999)]
    want = [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in times]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(i, t.isoformat(sep=" ")) for i, t in enumerate(times)], "i int, s string").select("i", F.col("s").cast("timestamp_ntz").alias("t"))
        assert [r.k for r in df.select("i", micros("t").alias("k")).orderBy("i").collect()] == want
        for v, t in zip(want, times, strict=True):
            assert spark.range(1).select(timestamp_literal(v).alias("t")).first().t == t
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("kind", ["ints", "hot", "floats", "decimals"])
def test_positions(spark, small, kind):
    r = random.Random(5)
    keys = {"ints": [r.randrange(-500, 500) for _ in range(400)], "hot": [7] * 300 + [r.randrange(20) for _ in range(100)], "floats": [r.gauss(0, 9) for _ in range(396)] + [0.0, -0.0, float("inf"), float("-inf")], "decimals": [Decimal(r.randrange(-900, 900)) / 4 for _ in range(400)]}[kind]
    column, store = {"floats": ("double", "f:8"), "decimals": ("decimal(20,2)", "f:16")}.get(kind, ("long", "i:8"))
    rows = list(enumerate(keys))
    r.shuffle(rows)
    d = FrameDataset(spark.createDataFrame(rows, f"i int, k {column}").repartition(5), Schema.parse("T", f"k:{store},i:i:4", 0), ties=("i",))

    def place(v):
        if not isinstance(v, float):
            return v
        bits = struct.unpack("<q", struct.pack("<d", v))[0]
        return bits if bits >= 0 else bits ^ (2**63 - 1)

    order = sorted(rows, key=lambda x: (place(x[1]), x[0]))
    ids = [i for i, _ in order]
    numbered = lambda df: [(x[INDEX], x.i) for x in df.orderBy(INDEX).collect()]
    for a, b in ((0, 3), (150, 170), (399, 400), (0, 400), (200, 200), (37, 361)):
        assert numbered(read.frames_slice(d, a, b)) == [(n, ids[n]) for n in range(a, b)]
    assert numbered(read.frame_at(d, 250)) == [(250, ids[250])] and read.frame_at(d, 400).isEmpty() and read.frame_at(d, -1).isEmpty()
    assert numbered(read.frames_chunk(d, 395, 50)) == [(n, ids[n]) for n in range(395, 400)]
    assert numbered(read.preview(d)) == [(n, ids[n]) for n in (0, 1, 2, 397, 398, 399)]
    for ranges in ([(5, 9)], [(0, 1), (100, 140), (390, 400)]):
        left, n = mutate.delete_ranges(d, ranges)
        gone = {ids[k] for a, b in ranges for k in range(a, b)}
        assert n == len(gone) and {x.i for x in left.df.collect()} == set(ids) - gone and left.df.count() == 400 - n
    left, n = mutate.delete_indices(d, [3, 4, 250])
    assert n == 3 and {x.i for x in left.df.collect()} == set(ids) - {ids[3], ids[4], ids[250]}
    left, found = mutate.delete_frame(d, 77)
    assert found and {x.i for x in left.df.collect()} == set(ids) - {ids[77]} and not mutate.delete_frame(d, 400)[1]
    if kind in ("ints", "hot"):
        for selectors in (["3..9"], ["..-1", "12..15", "14..40"], ["7"], ["900..901"]):
            want = [(n, i) for n, (i, v) in enumerate(order) if any((lo == "" or v >= int(lo)) and (hi == "" or v <= int(hi)) for lo, hi in ((s.split("..") if ".." in s else (s, s)) for s in selectors))]
            assert numbered(read.select_numbered(d, selectors)) == want


def test_neighbours_and_sums_across_chunks(spark, small):
    r = random.Random(6)
    places = sorted(r.sample(range(3000), 300))
    values = [None if r.random() < 0.1 else r.randrange(100) for _ in places]
    df = spark.createDataFrame(list(zip(places, values, strict=True)), "p long, v int").repartition(7)
    got = {x.p: x.before for x in ordering.with_previous(df, "p", F.col("v"), "before").collect()}
    assert got == dict(zip(places, [None, *values[:-1]], strict=True))
    sums = {x.p: x.s for x in ordering.with_sum_before(df, "p", F.coalesce("v", F.lit(0)), "s").collect()}
    total, want = 0, {}
    for p, v in zip(places, values, strict=True):
        want[p] = total
        total += v or 0
    assert sums == want


def test_order_checks_across_chunks(spark, small):
    keys = list(range(200))
    keys[120], keys[160] = 3, 159
    s = Schema.parse("T", "k:i:8,i:i:8", 0)
    d = FrameDataset(spark.createDataFrame([(k, i, i) for i, k in enumerate(keys)], f"k long, i long, {INDEX} long"), s)
    assert [(x.i, x.previous_key) for x in maintain.order_violations(d).orderBy("i").collect()] == [(120, 119)] + ([(160, 159)] if keys[160] < 159 else [])
    assert maintain.repair_cut(d).first().valid_frames == 120 and maintain.repair(d).df.count() == 120
    zones = spark.createDataFrame([(p, p * 10, 10, p, p, int(p // 7)) for p in range(100)], "page_id long, first_frame_index long, frame_count long, first_key long, last_key long, label int")
    assert maintain.contiguity_violations(zones).isEmpty() and maintain.contiguity_violations(zones.where("page_id <> 55")).count() == 1
    assert sorted((x.first_page, x.last_page) for x in pages.page_runs(zones).collect()) == [(a, min(a + 6, 99)) for a in range(0, 100, 7)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_ranges_reach_the_scan(spark):
    from keyframe import catalog as c

    for d, low, high in ((c.events(spark, SF), c.E_LOW, c.E_HIGH), (c.lineitem(spark, SF), c.L_LOW, c.L_HIGH)):
        plan = plan_of(read.frames_between(d, low, high))
        assert "GreaterThanOrEqual(" in plan.split("PushedFilters")[1] and "LessThanOrEqual(" in plan.split("PushedFilters")[1]
        picked = read.select_numbered(d, [f"{low}..{high}"])
        assert "GreaterThanOrEqual(" in plan_of(picked.select(INDEX, "k")).split("PushedFilters")[1]


def test_no_row_meets_all_others(spark, small):
    """What is sorted alone is one row for each chunk; rows are compared in windows of a chunk."""
    from keyframe import catalog as c

    d = c.events(spark, SF).numbered()
    plan = maintain.order_violations(d)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_chunk" in w or "_part" in w for w in windows)
