"""One case per cell of the rule table."""

import pytest
from helpers import frame, rows, ts
from pyspark.sql import functions as F

from pulsemill.operators.chunked import by_day, by_month, by_year
from pulsemill.operators.counters import (DELTA_RULES, cook_counters, counter_delta, delta_from_first, query_deltas,
                                          ratio_at_stamp, with_latency)

SCHEMA = "k string, ts timestamp, a bigint, b bigint, epoch timestamp, clock bigint"
E1, E2 = ts(-100), ts(5)


def snap(spark, data):
    return frame(spark, SCHEMA, data)


def deltas(df, **kw):
    return rows(counter_delta(df, "k", "ts", ["a", "b"], **kw), "k", "ts", "delta_a", "delta_b")


def test_first_is_null_value_or_absent(spark):
    df = snap(spark, [("x", ts(0), 5, 1, E1, 0), ("x", ts(1), 7, 1, E1, 1)])
    assert deltas(df) == [("x", ts(1), 2, 0)]
    assert deltas(df, first="value") == [("x", ts(0), 5, 1), ("x", ts(1), 2, 0)]
    assert deltas(df, drop_zero=False) == [("x", ts(0), None, None), ("x", ts(1), 2, 0)]
    assert deltas(df, first="absent", drop_zero=False) == [("x", ts(1), 2, 0)]


@pytest.mark.parametrize("minutes,op,known", [(12 * 60, ">", True), (12 * 60 + 59, ">", True), (13 * 60, ">", False),
                                              (11 * 60 + 59, ">=", True), (12 * 60, ">=", False)])
def test_gap_counts_hour_boundaries(spark, minutes, op, known):
    df = snap(spark, [("x", ts(0), 5, 1, E1, 0), ("x", ts(0, minutes=minutes), 7, 2, E1, 1)])
    got = deltas(df, max_gap=12, gap_op=op)
    assert got == ([("x", ts(0, minutes=minutes), 2, 1)] if known else [])


def test_gap_of_two_minutes_may_cross_an_hour(spark):
    df = snap(spark, [("x", ts(0, minutes=59), 5, 1, E1, 0), ("x", ts(13, minutes=1), 7, 2, E1, 1)])
    assert deltas(df, max_gap=12) == []


def test_falling_value_resets_that_counter_only(spark):
    df = snap(spark, [("x", ts(0), 5, 10, E1, 0), ("x", ts(1), 3, 14, E1, 1)])
    assert deltas(df) == [("x", ts(1), 3, 4)]


def test_new_epoch_resets_even_a_higher_value(spark):
    df = snap(spark, [("x", ts(4), 5, 10, E1, 0), ("x", ts(6), 9, 14, E2, 1)])
    assert deltas(df, epoch="epoch") == [("x", ts(6), 9, 14)]
    assert deltas(df) == [("x", ts(6), 4, 4)]


def test_unknown_epoch_of_the_previous_row_is_a_first_sight(spark):
    df = snap(spark, [("x", ts(4), 5, 10, None, 0), ("x", ts(6), 9, 14, E2, 1)])
    assert deltas(df, epoch="epoch", drop_zero=False)[1] == ("x", ts(6), None, None)


def test_clock_running_backwards_resets(spark):
    df = snap(spark, [("x", ts(4), 5, 10, E1, 900), ("x", ts(6), 9, 14, E1, 100)])
    assert deltas(df, clock="clock") == [("x", ts(6), 9, 14)]


def test_rows_without_a_known_gain_are_dropped(spark):
    df = snap(spark, [("x", ts(0), None, 1, E1, 0), ("x", ts(1), 3, 1, E1, 1), ("x", ts(2), 3, 1, E1, 2)])
    assert deltas(df) == []
    assert len(deltas(df, drop_zero=False)) == 3


def test_previous_row_is_found_days_back_and_null_keys_are_one_entity(spark):
    df = snap(spark, [(None, ts(1), 5, 1, E1, 0), (None, ts(24 * 9), 8, 2, E1, 1), ("x", ts(24 * 5), 1, 1, E1, 1)])
    assert deltas(df) == deltas(df, chunk=by_day("ts")) == [(None, ts(24 * 9), 3, 1)]


@pytest.mark.parametrize("chunk", [by_day, by_month, by_year])
def test_chunks_do_not_show(spark, chunk):
    df = snap(spark, [("x", ts(24 * 20 * i), i * i, i, E1, i) for i in range(40)])
    assert deltas(df, chunk=chunk("ts")) == [("x", ts(24 * 20 * i), 2 * i - 1, 1) for i in range(1, 40)]


def test_previous_snapshot_is_table_wide(spark):
    df = snap(spark, [("x", ts(0), 5, 1, E1, 0), ("y", ts(0), 1, 1, E1, 0), ("y", ts(1), 2, 2, E1, 0),
                      ("x", ts(2), 9, 3, E1, 0), ("y", ts(2), 4, 4, E1, 0)])
    # x is missing at hour 1, so at hour 2 it has no row in the previous snapshot.
    assert deltas(df, prev="snapshot", first="absent") == [("y", ts(1), 1, 1), ("y", ts(2), 2, 2)]
    assert ("x", ts(2), 9, 3) in deltas(df, prev="snapshot", first="value")
    assert ("x", ts(2), 4, 2) in deltas(df)


def test_sum_of_deltas_is_last_minus_first_without_reset(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
                                 (F.col("id") * F.col("id")).alias("a"), F.col("id").alias("b"),
                                 F.lit(E1).cast("timestamp").alias("epoch"), F.col("id").alias("clock"))
    got = counter_delta(df, "k", "ts", ["a", "b"]).groupBy("k").agg(F.sum("delta_a").alias("a"), F.sum("delta_b").alias("b"))
    want = df.groupBy("k").agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b"))
    assert rows(got) == rows(want)


def test_all_standard_rules_run(spark):
    df = snap(spark, [("x", ts(0), 5, 1, E1, 0), ("x", ts(1), 7, 1, E1, 1)])
    df = df.withColumnRenamed("epoch", "restart_ts").withColumnRenamed("clock", "sample_ms")
    for name, rule in DELTA_RULES.items():
        assert counter_delta(df, "k", "ts", ["a", "b"], **rule).count() >= 1, name


def test_latency_is_null_without_operations(spark):
    df = frame(spark, "stall bigint, ops bigint", [(10, 4), (10, 0)])
    assert rows(with_latency(df, "stall", "ops", "ms"), "ms") == [(2.5,), (None,)]


def test_delta_from_first_uses_all_samples_for_the_first(spark):
    df = frame(spark, "s int, ts timestamp, cpu bigint, txt string",
               [(1, ts(0), 10, "skip"), (1, ts(1), 15, "q"), (1, ts(2), 19, "skip"), (2, ts(3), 7, "q")])
    got = delta_from_first(df, "s", "ts", ["cpu"], keep=F.col("txt") != "skip")
    assert rows(got, "s", "ts", "delta_cpu", "seconds_since_last_seen") == [(1, ts(1), 5, 7200), (2, ts(3), 0, 0)]


PERF = "object string, counter string, instance string, value bigint, type int, ts_utc timestamp"


def perf(spark, *series):
    data = [("O", name, "i", v, kind, ts(0, minutes=m)) for name, kind, points in series for m, v in points]
    return frame(spark, PERF, data)


def test_cooked_values_by_type(spark):
    df = perf(spark, ("Pages", 65792, [(0, 4), (5, 6)]), ("Reads/sec", 272696576, [(0, 0), (5, 650)]),
              ("Average Wait Time (ms)", 1073874176, [(0, 100), (5, 900)]), ("Average Wait Time Base", 1073939712, [(0, 3), (5, 40)]),
              ("Hit Ratio", 537003264, [(0, 1), (5, 2)]), ("Hit Ratio Base", 1073939712, [(0, 3), (5, 3)]))
    got = {r.counter: r.cooked_value for r in cook_counters(df).collect()}
    assert got == {"Pages": 6.0, "Reads/sec": 2.0, "Average Wait Time (ms)": 20.0, "Hit Ratio": 0.667}


def test_cooked_gap_must_be_1_to_60_minutes_and_negatives_are_null(spark):
    df = perf(spark, ("Pages", 65792, [(0, 4), (61, 6), (62, -1)]))
    assert rows(cook_counters(df), "ts_utc", "cooked_value") == [(ts(0, minutes=62), None)]


def test_ratio_lifts_a_zero_numerator_and_needs_both(spark):
    df = frame(spark, "i string, ts timestamp, c string, v double",
               [("a", ts(0), "n", 0.0), ("a", ts(0), "d", 4.0), ("a", ts(1), "n", 3.0), ("b", ts(0), "n", 1.0), ("b", ts(0), "d", 0.0)])
    got = ratio_at_stamp(df, "i", "ts", "v", F.col("c") == "n", F.col("c") == "d")
    assert rows(got, "i", "ratio") == [("a", 0.25), ("b", None)]


def test_query_deltas_add_plans_up(spark):
    df = frame(spark, "q string, p string, ts timestamp, n bigint",
               [("q", "p1", ts(0), 5), ("q", "p1", ts(0), 1), ("q", "p1", ts(1), 9), ("q", "p2", ts(1), 4)])
    assert rows(query_deltas(df, "q", "p", "ts", ["n"]), "q", "ts", "n") == [("q", ts(0), 6), ("q", ts(1), 7)]
