"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import FrameDataset, StoredKey
from .functions import render
from .functions.keys import parse_key
from .operators import maintain, mutate, organize, pages, read, strings
from .plans.ordering import INDEX, merged_ranges, with_index
from .plans.selectors import Selector, bounds
from .types import Schema, richest

Query = Callable[[SparkSession, str], DataFrame]

EVENT = Schema.parse("Event", "k:i:8:unix-microseconds,event_id:i:8,user_id:i:8,event_type:sidx:1", 0)
LINE = Schema.parse("Line", "k:i:8:unix-microseconds,l_orderkey:i:8,l_partkey:i:8,l_suppkey:i:8,l_linenumber:i:4,qty:i:8,cents:i:8:fixed-2,disc:i:8:percent-0,tax:i:8:percent-0,l_returnflag:utf8:1,l_linestatus:utf8:1", 0)
ORDER = Schema.parse("Order", "o_orderkey:i:8,o_custkey:i:8,o_orderstatus:utf8:1,cents:i:8:fixed-2,o_orderpriority:utf8:15", 0)

JAN, FEB = 1_704_067_200_000_000, 1_706_745_600_000_000  # 2024-01-01 and 2024-02-01 in microseconds
DAY = 86_400_000_000
E_LOW, E_HIGH = JAN + 3 * DAY, JAN + 10 * DAY
L_HIT, L_MISS, L_BELOW, L_ABOVE = 897_868_800_000_000, 897_868_800_000_001, 0, 4_102_444_800_000_000  # 1998-06-15 and around
L_LOW, L_HIGH = 883_612_800_000_000, 886_291_200_000_000  # 1998-01-01 .. 1998-02-01
CUTS = [820_454_400_000_000, 883_612_800_000_000, 883_612_800_000_000, 946_684_800_000_000]  # 1996, 1998 twice, 2000
O_KEYS = [3, 3, 7, 32, 33, 1_000_000_000]
O_SELECTORS = ["1400..", "2", "5..7", "..0", "6", "100..120", "110..130", "131"]
PAGE_ROWS = 1024


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone: no step passes through one."""
    t = f"CAST({column} AS TIMESTAMP_NTZ)"
    seconds = f"(unix_date(CAST({t} AS DATE)) * 86400L + hour({t}) * 3600 + minute({t}) * 60)"
    return F.expr(f"{seconds} * 1000000L + CAST(extract(SECOND FROM {t}) * 1000000 AS BIGINT)")


def timestamp_literal(value: int) -> Column:
    """The timestamp without zone that micros turns into value, or the nearest that there is."""
    try:
        t = datetime(1970, 1, 1) + timedelta(microseconds=value)
    except OverflowError:
        t = datetime.max if value > 0 else datetime.min
    return F.expr(f"TIMESTAMP_NTZ'{t.isoformat(sep=' ', timespec='microseconds')}'")


def events(spark: SparkSession, sf_dir: str) -> FrameDataset:
    df = load(spark, sf_dir, "events").select(micros("ts").alias("k"), "event_id", "user_id", "event_type")
    return FrameDataset(df, EVENT, "events", stored=StoredKey("ts", timestamp_literal))


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def lineitem(spark: SparkSession, sf_dir: str) -> FrameDataset:
    df = load(spark, sf_dir, "lineitem").select(
        micros("l_shipdate").alias("k"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_quantity").cast("long").alias("qty"), cents("l_extendedprice").alias("cents"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), "l_returnflag", "l_linestatus",
    )
    return FrameDataset(df, LINE, "lineitem", ties=tuple(LINE.names[1:]), stored=StoredKey("l_shipdate", timestamp_literal))


def orders(spark: SparkSession, sf_dir: str) -> FrameDataset:
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("cents"), "o_orderpriority")
    return FrameDataset(df, ORDER, "orders")


# ---- the same frame sets in SQL

E_SQL = "(SELECT epoch_us(ts) AS k, event_id, user_id, event_type, row_number() OVER (ORDER BY ts) - 1 AS idx FROM events)"
_L_COLS = "epoch_us(l_shipdate) AS k, l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag, l_linestatus"
L_SQL = f"(SELECT *, row_number() OVER (ORDER BY {', '.join(LINE.names)}) - 1 AS idx FROM (SELECT {_L_COLS} FROM lineitem))"
O_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority FROM orders)"
P_SQL = f"(SELECT idx // {PAGE_ROWS} AS page_id, min(idx) AS first_frame_index, count(*) AS frame_count, min(k) AS first_key, max(k) AS last_key, max(CASE WHEN event_type = 'purchase' AND user_id % 97 = 0 THEN 1 ELSE 0 END) AS label FROM {E_SQL} GROUP BY 1)"
E_COLS = "idx AS frame_index, k, event_id, user_id, event_type"
L_NAMES = ", ".join(LINE.names)
O_NAMES = ", ".join(ORDER.names)


def e_out(df: DataFrame) -> DataFrame:
    return df.select(F.col(INDEX).alias("frame_index"), "k", "event_id", "user_id", "event_type")


def numbered(df: DataFrame, *names: str) -> DataFrame:
    return df.select(F.col(INDEX).alias("frame_index"), *names)


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def simple(name: str, source, build, sql: str) -> None:
    """A query that applies build to one frame set."""
    query(name, sql)(lambda spark, d: build(source(spark, d)))


# ---- scans and positions

query("flagship", f"SELECT frame_index, k, user_id, event_type FROM (SELECT {E_COLS} FROM {E_SQL}) WHERE k BETWEEN {E_LOW} AND {E_HIGH}")(
    lambda s, d: e_out(read.select_numbered(events(s, d), [f"{E_LOW}..{E_HIGH}"])).select("frame_index", "k", "user_id", "event_type")
)
simple("scan_all", events, lambda x: e_out(x.numbered().df), f"SELECT {E_COLS} FROM {E_SQL}")
simple("scan_lineitem", lineitem, lambda x: numbered(x.numbered().df, *LINE.names), f"SELECT idx AS frame_index, {L_NAMES} FROM {L_SQL}")
simple("frame_count", lineitem, lambda x: x.df.agg(F.count("*").alias("frame_count")), "SELECT count(*) AS frame_count FROM lineitem")
simple("first_last_key", lineitem, read.boundary_keys, f"SELECT count(*) AS frame_count, min(k) AS first_key, max(k) AS last_key FROM {L_SQL}")
simple("first_last_key_events", events, read.boundary_keys, f"SELECT count(*) AS frame_count, min(k) AS first_key, max(k) AS last_key FROM {E_SQL}")
simple("first_frame", events, read.boundary, f"SELECT k, event_id, user_id, event_type FROM {E_SQL} ORDER BY k LIMIT 1")
simple("last_frame", events, lambda x: read.boundary(x, last=True), f"SELECT k, event_id, user_id, event_type FROM {E_SQL} ORDER BY k DESC LIMIT 1")
simple("first_frame_lineitem", lineitem, read.boundary, f"SELECT {L_NAMES} FROM {L_SQL} WHERE idx = 0")
simple("frame_at_index", events, lambda x: e_out(read.frame_at(x, 500)), f"SELECT {E_COLS} FROM {E_SQL} WHERE idx = 500")
simple("frame_at_index_outside", events, lambda x: e_out(read.frame_at(x, 10**12)), f"SELECT {E_COLS} FROM {E_SQL} WHERE idx = 1000000000000")
simple("key_at_index", events, lambda x: numbered(read.key_at(x, 77), "k"), f"SELECT idx AS frame_index, k FROM {E_SQL} WHERE idx = 77")
simple("frames_slice", events, lambda x: e_out(read.frames_slice(x, 100, 220)), f"SELECT {E_COLS} FROM {E_SQL} WHERE idx >= 100 AND idx < 220")
simple("raw_chunk_limit", events, lambda x: e_out(read.frames_chunk(x, 990, 50)), f"SELECT {E_COLS} FROM {E_SQL} ORDER BY idx LIMIT 50 OFFSET 990")
simple("raw_chunk_past_end", events, lambda x: e_out(read.frames_chunk(x, 10**9, 50)), f"SELECT {E_COLS} FROM {E_SQL} WHERE idx >= 1000000000")

# ---- bounds

for _name, _value in (("hit", L_HIT), ("miss", L_MISS), ("below", L_BELOW), ("above", L_ABOVE)):
    simple(f"lower_bound_{_name}", lineitem, lambda x, v=_value: read.lower_bound(x, v), f"SELECT count(*) FILTER (WHERE k < {_value}) AS lower_bound FROM {L_SQL}")
    simple(f"upper_bound_{_name}", lineitem, lambda x, v=_value: read.upper_bound(x, v), f"SELECT count(*) FILTER (WHERE k <= {_value}) AS upper_bound FROM {L_SQL}")
    simple(f"equal_range_{_name}", lineitem, lambda x, v=_value: read.equal_range(x, v), f"SELECT count(*) FILTER (WHERE k < {_value}) AS start_idx, count(*) FILTER (WHERE k <= {_value}) AS end_idx FROM {L_SQL}")
_MANY = [L_BELOW, L_HIT, L_MISS, L_LOW, L_ABOVE]
simple("equal_range_many", lineitem, lambda x: read.equal_ranges(x, _MANY), f"SELECT v.key, (SELECT count(*) FROM {L_SQL} WHERE k < v.key) AS start_idx, (SELECT count(*) FROM {L_SQL} WHERE k <= v.key) AS end_idx FROM (VALUES {', '.join(f'({v}::BIGINT)' for v in _MANY)}) v(key)")
simple("equal_range_size", lineitem, read.key_counts, f"SELECT k AS key, count(*) AS n FROM {L_SQL} GROUP BY k")

# ---- key ranges and selectors

simple("frames_by_key", events, lambda x: read.frames_between(x, E_LOW, E_HIGH), f"SELECT k, event_id, user_id, event_type FROM {E_SQL} WHERE k BETWEEN {E_LOW} AND {E_HIGH}")
simple("frames_by_key_reversed", events, lambda x: read.frames_between(x, E_HIGH, E_LOW), f"SELECT k, event_id, user_id, event_type FROM {E_SQL} WHERE false")
simple("frames_by_key_lineitem", lineitem, lambda x: read.frames_between(x, L_LOW, L_HIGH), f"SELECT {L_NAMES} FROM {L_SQL} WHERE k BETWEEN {L_LOW} AND {L_HIGH}")
simple("frames_before", lineitem, lambda x: read.frames_before(x, L_HIT), f"SELECT {L_NAMES} FROM {L_SQL} WHERE k <= {L_HIT}")
simple("frames_after", lineitem, lambda x: read.frames_after(x, L_HIT), f"SELECT {L_NAMES} FROM {L_SQL} WHERE k >= {L_HIT}")
simple("frames_by_keys", orders, lambda x: read.frames_by_keys(x, O_KEYS), f"SELECT {O_NAMES} FROM {O_SQL} WHERE o_orderkey IN ({', '.join(map(str, O_KEYS))})")
simple("as_of", events, lambda x: read.as_of(x, E_LOW), f"SELECT k, event_id, user_id, event_type FROM {E_SQL} WHERE k <= {E_LOW} ORDER BY k DESC LIMIT 1")


def _where(column: str, selectors: list[str]) -> str:
    def one(t: str) -> str:
        a, dots, b = t.partition("..")
        return f"{column} = {a}" if not dots else " AND ".join([f"{column} >= {a}"] * bool(a) + [f"{column} <= {b}"] * bool(b))

    return " OR ".join(f"({one(t)})" for t in selectors)


def _ranges_sql(selectors: list[str]) -> str:
    """Position ranges of selectors over orders, and the merged ones, by gaps and islands."""
    rows = []
    for t in selectors:
        a, dots, b = t.partition("..")
        b = b if dots else a
        rows.append(f"SELECT {f'count(*) FILTER (WHERE o_orderkey < {a})' if a else '0::BIGINT'} AS s, {f'count(*) FILTER (WHERE o_orderkey <= {b})' if b else 'count(*)'} AS e FROM orders")
    raw = " UNION ALL ".join(rows)
    return f"(SELECT min(s) AS start_idx, max(e) AS end_idx FROM (SELECT *, sum(n) OVER (ORDER BY s, e) AS g FROM (SELECT s, e, CASE WHEN coalesce(max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < s, true) THEN 1 ELSE 0 END AS n FROM ({raw}) WHERE s < e)) GROUP BY g)"


def _ranges(x: FrameDataset) -> DataFrame:
    found = bounds(x.df, ORDER.key, [Selector.parse(ORDER.key, t) for t in O_SELECTORS])
    return merged_ranges(x.df.sparkSession.createDataFrame(found, "start_idx long, end_idx long"))


simple("selector_union_ranges", orders, _ranges, f"SELECT start_idx, end_idx FROM {_ranges_sql(O_SELECTORS)}")
simple("selector_union_frames", orders, lambda x: read.select(x, O_SELECTORS), f"SELECT {O_NAMES} FROM {O_SQL} WHERE {_where('o_orderkey', O_SELECTORS)}")


def _find(x: FrameDataset) -> DataFrame:
    f = read.find(x, O_SELECTORS)
    f.pop("ranges")
    return x.df.sparkSession.createDataFrame([tuple(f.values())], ", ".join(f"{k} long" for k in f))


simple("find_summary", orders, _find, f"SELECT {len(O_SELECTORS)}::BIGINT AS selector_count, count(*) AS range_count, min(start_idx) AS start_idx, max(end_idx) AS end_idx, CAST(sum(end_idx - start_idx) AS BIGINT) AS frame_count FROM {_ranges_sql(O_SELECTORS)}")
simple("preview", events, lambda x: e_out(read.preview(x)), f"SELECT {E_COLS} FROM {E_SQL} WHERE idx < 3 OR idx >= (SELECT count(*) FROM events) - 3")

# ---- deletes: what stays (numbered anew), and how many went


def _renumbered(x: FrameDataset) -> DataFrame:
    return e_out(x.numbered().df)


_AGAIN = "SELECT row_number() OVER (ORDER BY k) - 1 AS frame_index, k, event_id, user_id, event_type FROM"
for _name, _do, _gone in (
    ("delete_index", lambda x: mutate.delete_frame(x, 5), "idx = 5"),
    ("delete_slice", lambda x: mutate.delete_slice(x, 10, 400), "idx >= 10 AND idx < 400"),
    ("delete_indices", lambda x: mutate.delete_indices(x, [1, 4, 8, 600]), "idx IN (1, 4, 8, 600)"),
    ("delete_ranges", lambda x: mutate.delete_ranges(x, [(1, 3), (5, 7), (500, 900)]), "(idx >= 1 AND idx < 3) OR (idx >= 5 AND idx < 7) OR (idx >= 500 AND idx < 900)"),
):
    simple(_name, events, lambda x, do=_do: _renumbered(do(x)[0]), f"{_AGAIN} {E_SQL} WHERE NOT ({_gone})")
for _name, _source, _do, _gone, _table in (
    ("delete_key", lineitem, lambda x: mutate.delete_key(x, L_HIT), f"k = {L_HIT}", L_SQL),
    ("delete_keys", orders, lambda x: mutate.delete_keys(x, O_KEYS), f"o_orderkey IN ({', '.join(map(str, O_KEYS))})", O_SQL),
    ("delete_key_range", lineitem, lambda x: mutate.delete_key_range(x, L_LOW, L_HIGH), f"k BETWEEN {L_LOW} AND {L_HIGH}", L_SQL),
    ("delete_before", lineitem, lambda x: mutate.delete_before(x, L_HIT), f"k <= {L_HIT}", L_SQL),
    ("delete_after", lineitem, lambda x: mutate.delete_after(x, L_HIT), f"k >= {L_HIT}", L_SQL),
    ("delete_all", orders, mutate.delete_all, "true", O_SQL),
    ("remove_selection", orders, lambda x: mutate.remove(x, O_SELECTORS), _where("o_orderkey", O_SELECTORS), O_SQL),
):
    _cols = O_NAMES if _table == O_SQL else L_NAMES
    simple(_name, _source, lambda x, do=_do: do(x)[0].frames(), f"SELECT {_cols} FROM {_table} WHERE NOT ({_gone})")
    simple(f"{_name}_count", _source, lambda x, do=_do: x.df.sparkSession.createDataFrame([(do(x)[1],)], "removed long"), f"SELECT count(*) AS removed FROM {_table} WHERE {_gone}")

# ---- appends


def _shuffled(x: FrameDataset) -> FrameDataset:
    """The events as they would arrive ordered by user."""
    return FrameDataset(with_index(x.df, ["user_id", "k"], name="seq"), x.schema, x.title)


_SEQ = f"(SELECT k, event_id, user_id, event_type, row_number() OVER (ORDER BY user_id, k) - 1 AS seq FROM {E_SQL})"
simple("append_gate_violations", events, lambda x: mutate.order_violations(x, _shuffled(x).df, "seq").select("seq", "k", "previous_key"), f"SELECT seq, k, previous_key FROM (SELECT *, lag(k) OVER (ORDER BY seq) AS previous_key FROM {_SEQ}) WHERE k < previous_key")
simple("append_gate_ok", events, lambda x: mutate.order_violations(x, x.numbered().df, INDEX).agg(F.count("*").alias("violations")), "SELECT 0::BIGINT AS violations")


def _halves(x: FrameDataset) -> list[FrameDataset]:
    return [x.of(x.df.where(F.col("k") < E_HIGH)), x.of(x.df.where(F.col("k") >= E_HIGH))]


simple("append_transactional", events, lambda x: mutate.append_transactional(_halves(x)[0], _halves(x)[1].numbered().df, INDEX).df, f"SELECT k, event_id, user_id, event_type FROM {E_SQL}")
simple("append_presorted_boundary", events, lambda x: organize.boundaries(_halves(x)).select("source", "frame_count", "first_key", "last_key", "disordered"), f"SELECT * FROM (SELECT 0::BIGINT AS source, count(*) AS frame_count, min(k) AS first_key, max(k) AS last_key, false AS disordered FROM {E_SQL} WHERE k < {E_HIGH} UNION ALL SELECT 1, count(*), min(k), max(k), coalesce(min(k) < (SELECT max(k) FROM {E_SQL} WHERE k < {E_HIGH}), false) FROM {E_SQL} WHERE k >= {E_HIGH})")

# ---- organisation

simple("concat_parts", events, lambda x: e_out(organize.concat(_halves(x)).numbered().df), f"SELECT {E_COLS} FROM {E_SQL}")
simple("concat_boundary_check", events, lambda x: organize.boundaries(_halves(x)[::-1]).select("source", "frame_count", "first_key", "last_key", "disordered"), f"SELECT 0::BIGINT AS source, count(*) AS frame_count, min(k) AS first_key, max(k) AS last_key, false AS disordered FROM {E_SQL} WHERE k >= {E_HIGH} UNION ALL SELECT 1, count(*), min(k), max(k), coalesce(min(k) < (SELECT max(k) FROM {E_SQL} WHERE k >= {E_HIGH}), false) FROM {E_SQL} WHERE k < {E_HIGH}")
_PART = " + ".join(f"CASE WHEN k >= {c} THEN 1 ELSE 0 END" for c in CUTS)
simple("split_parts", lineitem, lambda x: organize.split(x, CUTS, keep_empty=True).select("part", *LINE.names), f"SELECT CAST({_PART} AS BIGINT) AS part, {L_NAMES} FROM {L_SQL}")
simple("split_keep_empty", lineitem, lambda x: organize.split_counts(x, CUTS, keep_empty=True), f"SELECT p AS part, (SELECT count(*) FROM {L_SQL} WHERE {_PART} = p) AS frame_count FROM range({len(CUTS) + 1}) t(p)")
simple("split_drop_empty", lineitem, lambda x: organize.split_counts(x, CUTS), f"SELECT dense_rank() OVER (ORDER BY p) - 1 AS part, n AS frame_count FROM (SELECT {_PART} AS p, count(*) AS n FROM {L_SQL} GROUP BY 1)")

# ---- string tables

_STRINGS = "(SELECT row_number() OVER (ORDER BY event_type) - 1 AS idx, event_type AS value FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL))"


def _table(x: FrameDataset) -> DataFrame:
    return strings.build(x.df, "event_type")


simple("string_table", events, _table, f"SELECT idx, value FROM {_STRINGS}")
simple("string_encode", events, lambda x: strings.encode(x.df, _table(x), "event_type", "code").select("event_id", "code"), f"SELECT e.event_id, s.idx AS code FROM events e JOIN {_STRINGS} s ON e.event_type = s.value")
simple("string_decode", events, lambda x: strings.decode(strings.encode(x.df, _table(x), "event_type", "code").select("event_id", "code"), _table(x), "code", "event_type").select("event_id", "event_type"), "SELECT event_id, event_type FROM events")
simple("string_reverse_last", events, lambda x: strings.reverse(_table(x).union(_table(x).select(F.col("idx") + 100, "value").where("idx % 2 = 0"))), f"SELECT value, max(idx) AS idx FROM (SELECT idx, value FROM {_STRINGS} UNION ALL SELECT idx + 100, value FROM {_STRINGS} WHERE idx % 2 = 0) GROUP BY value")
simple("string_table_merge_conflicts", events, lambda x: strings.conflicts(_table(x), _table(x).select("idx", F.when(F.col("idx") == 1, "other").otherwise(F.col("value")).alias("value"))), f"SELECT idx, value AS left_value, 'other' AS right_value FROM {_STRINGS} WHERE idx = 1 AND value <> 'other'")

# ---- semantics and rendering

_COMMA = "format('{{:,}}', {0})".replace("{{", "{").replace("}}", "}")


def _fixed_sql(v: str, n: int) -> str:
    whole = "format('{:,}', abs(" + v + f") // {10**n})"
    sign = f"CASE WHEN {v} < 0 THEN '-' ELSE '' END"
    return f"{sign} || {whole}" + (f" || '.' || lpad(CAST(abs({v}) % {10**n} AS VARCHAR), {n}, '0')" if n else "")


simple("semantic_ts_us", events, lambda x: x.df.select("event_id", render.timestamp(F.col("k"), "unix-microseconds").alias("shown")), f"SELECT event_id, strftime(make_timestamp(k), '%Y-%m-%dT%H:%M:%S.%fZ') AS shown FROM {E_SQL}")
simple("semantic_ts_ms", events, lambda x: x.df.select("event_id", render.timestamp(F.floor(F.col("k") / 1000), "unix-milliseconds").alias("shown")), f"SELECT event_id, strftime(make_timestamp(k), '%Y-%m-%dT%H:%M:%S.%gZ') AS shown FROM {E_SQL}")
simple("semantic_ts_s", events, lambda x: x.df.select("event_id", render.timestamp(F.floor(F.col("k") / 1000000), "unix-seconds").alias("shown")), f"SELECT event_id, strftime(make_timestamp(k), '%Y-%m-%dT%H:%M:%SZ') AS shown FROM {E_SQL}")
simple("semantic_ts_ns", events, lambda x: x.df.select("event_id", render.timestamp(F.col("k") * 1000 + 7, "unix-nanoseconds").alias("shown")), f"SELECT event_id, strftime(make_timestamp(k), '%Y-%m-%dT%H:%M:%S.%f') || '007Z' AS shown FROM {E_SQL}")
simple("semantic_ts_before_1970", events, lambda x: x.df.select("event_id", render.timestamp(F.col("k") - 2 * JAN, "unix-microseconds").alias("shown")), f"SELECT event_id, strftime(make_timestamp(k - {2 * JAN}), '%Y-%m-%dT%H:%M:%S.%fZ') AS shown FROM {E_SQL}")
simple("semantic_fixed", lineitem, lambda x: x.df.select("l_orderkey", "l_linenumber", "cents", render.fixed_point(F.col("cents") - 5_000_000, 2).alias("fixed2"), render.fixed_point(F.col("cents"), 4).alias("fixed4"), render.fixed_point(F.col("cents"), 0).alias("fixed0")), f"SELECT l_orderkey, l_linenumber, cents, {_fixed_sql('(cents - 5000000)', 2)} AS fixed2, {_fixed_sql('cents', 4)} AS fixed4, {_fixed_sql('cents', 0)} AS fixed0 FROM {L_SQL}")
simple("semantic_percent", lineitem, lambda x: x.df.select("l_orderkey", "l_linenumber", "cents", render.fixed_point(F.col("disc") - 5, 2, percent=True).alias("shown")), f"SELECT l_orderkey, l_linenumber, cents, {_fixed_sql('(disc - 5)', 2)} || '%' AS shown FROM {L_SQL}")
_NULL = Schema.parse("N", "a:i:4:fixed-2").key
simple("semantic_null", lineitem, lambda x: x.df.select("l_orderkey", "l_linenumber", "cents", render.display(_NULL, F.when(F.col("l_returnflag") == "N", F.lit(-(1 << 31))).otherwise(F.col("qty").cast("int"))).alias("shown")), f"SELECT l_orderkey, l_linenumber, cents, CASE WHEN l_returnflag = 'N' THEN NULL ELSE {_fixed_sql('qty', 2)} END AS shown FROM {L_SQL}")

_TEXT = Schema.parse("Event", "k:i:8:unix-microseconds,event_id:i:8,cents:i:8:fixed-2,event_type:utf8:12,props:utf8:200", 0)
_TEXT_SQL = "(SELECT epoch_us(ts) AS k, event_id, CAST(round(value * 100) AS BIGINT) AS cents, event_type, props FROM events)"
_TS = "strftime(make_timestamp(k), '%Y-%m-%dT%H:%M:%S.%fZ')"
_WIDTHS = [render.width(f, ()) for f in _TEXT.fields]


def _hex_le(v: str) -> str:
    big = f"lpad(format('{{:x}}', CASE WHEN {v} < 0 THEN CAST({v} AS HUGEINT) + 18446744073709551616 ELSE {v} END), 16, '0')"
    return " || ".join(f"substr({big}, {15 - 2 * i}, 2)" for i in range(8))


def text_events(spark: SparkSession, sf_dir: str) -> FrameDataset:
    df = load(spark, sf_dir, "events").select(micros("ts").alias("k"), "event_id", cents("value").alias("cents"), "event_type", "props")
    return FrameDataset(df, _TEXT, "events")


_CSV = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_JSON = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
for _fmt, _sql in (
    ("raw", "concat_ws(' ', k, event_id, cents, event_type, props)"),
    ("csv", f"concat_ws(',', k, event_id, cents, {_CSV.format('event_type')}, {_CSV.format('props')})"),
    ("jsonl", f"'{{\"k\":' || k || ',\"event_id\":' || event_id || ',\"cents\":' || cents || ',\"event_type\":' || {_JSON.format('event_type')} || ',\"props\":' || {_JSON.format('props')} || '}}'"),
    ("md", f"'| ' || {_TS} || ' | ' || event_id || ' | ' || {_fixed_sql('cents', 2)} || ' | ' || replace(event_type, '|', '\\|') || ' | ' || replace(props, '|', '\\|') || ' |'"),
    ("table", f"rtrim(lpad({_TS}, {_WIDTHS[0]}, ' ') || '  ' || lpad(CAST(event_id AS VARCHAR), {_WIDTHS[1]}, ' ') || '  ' || lpad({_fixed_sql('cents', 2)}, {_WIDTHS[2]}, ' ') || '  ' || rpad(event_type, greatest({_WIDTHS[3]}, length(event_type))::INT, ' ') || '  ' || rpad(props, greatest({_WIDTHS[4]}, length(props))::INT, ' '))"),
    ("hex", f"{_hex_le('k')} || {_hex_le('event_id')} || {_hex_le('cents')} || rpad(lower(hex(event_type)), 24, '20') || rpad(lower(hex(props)), 400, '20')"),
):
    simple(f"render_{_fmt}", text_events, lambda x, fmt=_fmt: x.df.select("event_id", render.line(x, fmt).alias("line")), f"SELECT event_id, {_sql} AS line FROM {_TEXT_SQL}")
simple("preview_cells", lineitem, lambda x: x.df.select("l_orderkey", "l_linenumber", "cents", render.preview_cell(LINE.fields[6], F.col("cents")).alias("cell")), f"SELECT l_orderkey, l_linenumber, cents, format('{{:,}}', cents) AS cell FROM {L_SQL}")

# ---- pages


def zones(x: FrameDataset) -> DataFrame:
    label = F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 97 == 0), 1).otherwise(0)
    return pages.zone_map(x, PAGE_ROWS, label)


_Z = "page_id, first_frame_index, frame_count, first_key, last_key, label"
simple("page_layout", events, lambda x: pages.paged(x, PAGE_ROWS).select("page_id", F.col(INDEX).alias("frame_index"), "event_id"), f"SELECT idx // {PAGE_ROWS} AS page_id, idx AS frame_index, event_id FROM {E_SQL}")
simple("page_zone_map", events, lambda x: zones(x).select(*_Z.split(", ")), f"SELECT {_Z} FROM {P_SQL}")
simple("page_stats", events, lambda x: pages.page_stats(zones(x)), f"SELECT count(*) AS page_count, CAST(sum(frame_count) AS BIGINT) AS frame_count, min(frame_count) AS min_frames, max(frame_count) AS max_frames FROM {P_SQL}")
simple("page_runs", events, lambda x: pages.page_runs(zones(x)).drop("run"), f"SELECT max(label) AS label, min(page_id) AS first_page, max(page_id) AS last_page, CAST(sum(frame_count) AS BIGINT) AS frame_count, min(first_key) AS first_key, max(last_key) AS last_key FROM (SELECT *, sum(n) OVER (ORDER BY page_id) AS run FROM (SELECT *, CASE WHEN label = lag(label) OVER (ORDER BY page_id) THEN 0 ELSE 1 END AS n FROM {P_SQL})) GROUP BY run")
simple("page_for_index", events, lambda x: pages.page_for_index(zones(x), 900), f"SELECT page_id FROM {P_SQL} WHERE first_frame_index <= 900 AND first_frame_index + frame_count > 900")
simple("page_for_key", events, lambda x: pages.page_for_key(zones(x), E_LOW), f"SELECT page_id FROM (SELECT * FROM {P_SQL} WHERE last_key >= {E_LOW} ORDER BY page_id LIMIT 1) WHERE first_key <= {E_LOW}")
simple("first_frame_index_prefix", lineitem, lambda x: pages.prefix_sums(x.df.groupBy(F.floor(F.col("k") / DAY).alias("page_id")).agg(F.count("*").alias("frame_count"))), f"SELECT page_id, frame_count, CAST(coalesce(sum(frame_count) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_frame_index FROM (SELECT k // {DAY} AS page_id, count(*) AS frame_count FROM {L_SQL} GROUP BY 1)")
_DELTA = f"(SELECT idx, event_id, CAST(user_id - coalesce(lag(user_id) OVER (PARTITION BY idx // {PAGE_ROWS} ORDER BY idx), 0) AS BIGINT) AS delta, user_id FROM {E_SQL})"
simple("delta_encode", events, lambda x: pages.delta_encode(x, PAGE_ROWS, "user_id").select("event_id", "delta"), f"SELECT event_id, delta FROM {_DELTA}")
simple("delta_wrapped", events, lambda x: pages.delta_encode(x, PAGE_ROWS, "user_id", bits=8).select("event_id", "delta"), f"SELECT event_id, ((delta + 128) % 256 + 256) % 256 - 128 AS delta FROM {_DELTA}")
simple("delta_roundtrip", events, lambda x: pages.delta_decode(pages.delta_encode(x, PAGE_ROWS, "user_id")).select("event_id", "value"), "SELECT event_id, user_id AS value FROM events")

# ---- verification


def _broken(x: FrameDataset) -> FrameDataset:
    """Events with one key at position 700 put back by a day."""
    n = x.numbered()
    return FrameDataset(n.df.withColumn("k", F.when(F.col(INDEX) == 700, F.col("k") - DAY).otherwise(F.col("k"))), EVENT, "events")


_BROKEN = f"(SELECT idx, CASE WHEN idx = 700 THEN k - {DAY} ELSE k END AS k, event_id, user_id, event_type FROM {E_SQL})"
simple("verify_order", events, lambda x: numbered(maintain.order_violations(_broken(x)), "k", "previous_key"), f"SELECT idx AS frame_index, k, previous_key FROM (SELECT *, lag(k) OVER (ORDER BY idx) AS previous_key FROM {_BROKEN}) WHERE k < previous_key")
simple("verify_contiguous", events, lambda x: maintain.contiguity_violations(zones(x).where("page_id <> 0").withColumn("page_id", F.col("page_id") - 1)).select("page_id", "first_frame_index", "expected"), f"SELECT page_id, first_frame_index, expected FROM (SELECT page_id - 1 AS page_id, first_frame_index, coalesce(lag(first_frame_index + frame_count) OVER (ORDER BY page_id), 0) AS expected FROM {P_SQL} WHERE page_id <> 0) WHERE first_frame_index <> expected")
simple("repair_cut", events, lambda x: maintain.repair_cut(_broken(x)), f"SELECT coalesce((SELECT min(idx) FROM (SELECT idx, k, lag(k) OVER (ORDER BY idx) AS p FROM {_BROKEN}) WHERE k < p), (SELECT count(*) FROM events)) AS valid_frames")
simple("repair_prefix", events, lambda x: e_out(maintain.repair(_broken(x)).df), f"SELECT {E_COLS} FROM {_BROKEN} WHERE idx < coalesce((SELECT min(idx) FROM (SELECT idx, k, lag(k) OVER (ORDER BY idx) AS p FROM {_BROKEN}) WHERE k < p), 1000000000)")

# ---- types, catalogue

_KEYS = Schema.parse("Keys", "o_orderkey:i:8,cents:f:16,u8:u:1,u16:u:2,u64:u:8", 0)


def _parsed(x: FrameDataset) -> DataFrame:
    """Order keys shown, parsed again on the driver by the key field's rule, and found by what was parsed."""
    shown = [str(k) for k in O_KEYS]
    return read.frames_by_keys(x, [parse_key(ORDER.key, t) for t in shown]).select("o_orderkey", render.display(ORDER.key, F.col("o_orderkey")).alias("shown"))


simple("key_parse", orders, _parsed, f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS shown FROM orders WHERE o_orderkey IN ({', '.join(map(str, O_KEYS))})")
simple("unsigned_widen", orders, lambda x: x.df.select("o_orderkey", *[v.cast(_KEYS.spark_schema()[n].dataType).alias(n) for n, v in (("u8", F.col("o_orderkey") % 256), ("u16", F.col("o_orderkey") % 65536), ("u64", F.col("o_custkey")))]), "SELECT o_orderkey, CAST(o_orderkey % 256 AS SMALLINT) AS u8, CAST(o_orderkey % 65536 AS INTEGER) AS u16, CAST(o_custkey AS DECIMAL(20,0)) AS u64 FROM orders")


def _ls_sql(name: str, s: Schema, table: str, key: str) -> str:
    return f"SELECT '{name}' AS name, '{name}' AS title, '{s.frame_type}' AS frame_type, '{s.key.name}' AS key_field, {len(s.fields)}::BIGINT AS field_count, 0::BIGINT AS string_count, {s.frame_length}::BIGINT AS frame_length, count(*) AS frame_count, CAST(min({key}) AS VARCHAR) AS first_key, CAST(max({key}) AS VARCHAR) AS last_key, count(*) * {s.frame_length} AS data_bytes FROM {table}"


query("ls_row", " UNION ALL ".join([_ls_sql("events", EVENT, E_SQL, "k"), _ls_sql("lineitem", LINE, L_SQL, "k"), _ls_sql("orders", ORDER, O_SQL, "o_orderkey")]))(
    lambda s, d: maintain.ls({"events": events(s, d), "lineitem": lineitem(s, d), "orders": orders(s, d)})[0]
)


_PLAIN = Schema.parse("Event", "k:i:8,event_id:i:8,user_id:i:8,event_type:sidx:1", 0)


@query("richest_schema", " UNION ALL ".join(f"SELECT '{f.name}' AS field, '{f.semantic}' AS semantic" for f in EVENT.fields))
def _richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f.name, str(f.semantic)) for f in richest([_PLAIN, EVENT]).fields], "field string, semantic string")


def _facts_sql() -> str:
    facts = [("dataset", "title", "'events'"), ("dataset", "frame_type", "'Event'"), ("dataset", "frame_count", "(SELECT CAST(count(*) AS VARCHAR) FROM events)"), ("dataset", "frame_length", f"'{EVENT.frame_length}'"), ("dataset", "data_bytes", f"(SELECT CAST(count(*) * {EVENT.frame_length} AS VARCHAR) FROM events)")]
    facts += [("key", "field", "'k'"), ("key", "index", "'0'"), ("key", "float_order", "'False'"), ("strings", "count", "'0'"), ("strings", "values", "'[]'")]
    facts += [("fields", f.name, f"'{f.family.name.lower()}:{f.length}:{f.semantic}'") for f in EVENT.fields]
    return " UNION ALL ".join(f"SELECT '{a}' AS section, '{b}' AS fact, {c} AS value" for a, b, c in facts)


@query("inspect", _facts_sql())
def _inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maintain.inspect(events(spark, sf_dir))
    return spark.createDataFrame([(s, k, str(v)) for s, facts in found.items() for k, v in facts.items()], "section string, fact string, value string")


from . import catalog_files  # noqa: E402, F401  registers the queries over files, stores and streams


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
