"""Plan shapes that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pulsemill.operators import chunked, counters, select, state
from pulsemill.plans.tables import Tables
from pulsemill.sources.snapshots import insert_if_absent

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def test_all_lags_of_a_delta_share_one_exchange_of_the_rows(t):
    raw = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("b"))
    p = plan(counters.counter_delta(raw, "k", "ts", ["a", "b"], max_gap=12))
    # the rows (with seeds) once, and the partial summaries: by (key, chunk), then by key
    assert p.count("Exchange hashpartitioning") == 3
    assert len(re.findall(r"Window \[", p)) == 2
    assert "partial_max_by" in p and "NestedLoop" not in p and "CartesianProduct" not in p


def test_no_window_without_partition_keys_over_rows(t):
    p = plan(chunked.with_row_number(t.events.select("event_id", "ts"), [], ["ts", "event_id"]))
    assert "Exchange hashpartitioning(_chunk" in p


def test_newest_row_limits_groups_before_the_shuffle(t):
    p = plan(chunked.newest_per_group(t.events, "user_id", "ts"))
    assert p.count("WindowGroupLimit") == 2


def test_latest_snapshot_reaches_the_scan(t):
    p = plan(select.latest_snapshot(t.lineitem, "l_shipdate"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(l_shipdate,ScalarSubquery", p)
    p = plan(select.lookback(t.events, "ts", 7))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,ScalarSubquery", p)


def test_a_period_takes_few_readings_of_the_fact(spark):
    p = plan(queries()["l7_period_ratio"](spark, FOLDER))
    # the fact, its two days, and the bound on the scan, which is inferred for the days as well and reused at run time
    assert p.count("FileScan parquet") <= 5


def test_a_merge_of_histories_joins_once(spark):
    schema = "k string, v string, valid_from timestamp, valid_to timestamp"
    p = plan(state.scd2_merge(spark.createDataFrame([], schema), spark.createDataFrame([], "k string, v string"), "k", "v", F.current_timestamp()))
    assert len(re.findall(r"(?:SortMergeJoin|HashJoin)", p)) <= 1


def test_only_wanted_columns_are_read(t):
    p = plan(select.last_snapshot_per_day(t.events.select("event_id", "ts"), "ts"))
    assert "props" not in p and "Exchange hashpartitioning(event_id" not in p


def test_semi_and_anti_joins(t):
    assert "LeftAnti" in plan(insert_if_absent(t.orders, t.orders.filter("o_orderkey < 5"), "o_orderkey"))
    assert "LeftSemi" in plan(state.delete_orphans(t.part.select("p_partkey"), t.lineitem.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey"))


@pytest.mark.parametrize("name", sorted(n for n in queries() if not re.match(r"a[0-9]|m[0-9]", n)))
def test_no_nested_loops_over_rows_and_no_python(spark, name):
    p = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in p and "Python" not in p and "ArrowEval" not in p
    assert "BroadcastNestedLoopJoin" not in p
