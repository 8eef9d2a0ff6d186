import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SOME = ["flagship", "equal_range_many", "selector_union_ranges", "find_summary", "delete_ranges", "append_gate_violations", "split_drop_empty", "string_encode", "semantic_fixed", "render_csv", "page_runs", "page_for_key", "delta_wrapped", "repair_cut", "ls_row"]


def test_import_without_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["frame_index", "k", "user_id", "event_type"] and df.count() > 0


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(e.oracle_sql()[name])
    columns, rows = want.columns, want.fetchall()
    got = e.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    text = lambda r: tuple(map(str, r))
    assert sorted(text(r[c] for c in columns) for r in got.collect()) == sorted(map(text, rows))


def test_key_filters_reach_the_scan(spark):
    from keyframe.operators import read
    from keyframe.dataset import FrameDataset
    from keyframe.types import Schema

    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey")
    d = FrameDataset(df, Schema.parse("O", "o_orderkey:i:8,o_custkey:i:8"), "o")
    plan = read.select(d, ["5..9", "7..20", "100"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "LessThanOrEqual(o_orderkey,20)" in plan and "EqualTo(o_orderkey,100)" in plan
