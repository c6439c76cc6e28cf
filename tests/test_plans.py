"""Physical-plan properties that matter at scale (SURVEY §4 "watch in explain()")."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def ops(text):
    return re.findall(r"^\(\d+\) (\w+)", text, re.M)


@pytest.fixture(scope="module")
def q(spark, sf_dir):
    return lambda name: plan(entry.queries()[name](spark, sf_dir))


def test_filters_and_columns_reach_the_scan(q):
    t = q("build_master")
    assert "LessThan(o_orderdate,1999-01-01" in t and "GreaterThanOrEqual(o_orderdate,1998-01-01" in t
    orders_schemas = [s for s in re.findall(r"ReadSchema: (struct<[^\n]*>)", t) if "o_orderkey" in s]
    assert orders_schemas and all("o_orderpriority" not in s and "o_orderstatus" not in s for s in orders_schemas)


def test_dedup_is_a_map_side_combined_aggregation(q):
    names = ops(q("build_master"))
    aggs = [n for n in names if n.endswith("Aggregate")]
    assert len(aggs) >= 2            # partial + final
    assert "Window" not in names      # no per-key window over raw rows


def test_last_n_uses_a_partial_window_group_limit(q):
    assert "WindowGroupLimit" in ops(q("recent_table"))


def test_per_city_windows_share_one_exchange(q):
    t = q("sequences")
    assert ops(t).count("Exchange") == 1 and "hashpartitioning(city" in t


def test_no_python_in_the_forecast_path(q):
    for name in ("predict", "forecast_roll", "forecast_roll_72", "backtest_ar1", "backtest_arima"):
        names = ops(q(name))
        assert not any("EvalPython" in n for n in names), name


def test_no_cartesian_products(q):
    for name in ("current_status", "predict", "monitor_log", "compare_cities"):
        names = ops(q(name))
        assert "CartesianProduct" not in names, name


def test_as_of_join_has_no_unpartitioned_window_over_rows(q):
    t = q("monitor_log")
    # every window over the feed is partitioned: by (city, bucket), or by city over one row a bucket
    assert "Window" in ops(t)
    assert not re.search(r"Arguments: \[[^\]]*\], \[\], \[", t)
    # whole readings are dealt once, by (city, bucket), and nothing is sampled or written on the way
    feed = [x for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", t) if "pm25" in x]
    assert len(feed) == 1 and "rangepartitioning" not in t and "Scan ExistingRDD" not in t


def test_global_recent_log_is_a_top_k_not_a_global_window(spark, sf_dir):
    from smogcast.operators.tables import recent_log
    from smogcast.sources import standin as si
    df = recent_log(si.readings_log(spark, sf_dir), 20, key=None)
    names = ops(plan(df))
    assert "TakeOrderedAndProject" in names or "TopK" in " ".join(names) or "Limit" in " ".join(names)
    rows = df.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 21))
    assert all(rows[i].ts >= rows[i + 1].ts for i in range(19))
