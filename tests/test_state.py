"""H: histories, rollups and keyed tables; J1 to J5 on small cases."""

import random

from helpers import frame, rows, ts
from pyspark.sql import functions as F

from pulsemill.operators import runs, state
from pulsemill.operators.aggregate import hourly_rollup
from pulsemill.operators.chunked import by_range


def end():
    return F.lit("9999-12-31 23:59:59").cast("timestamp")


def observations(n_days=12, seed=3):
    r = random.Random(seed)
    return [(e, ts(24 * d), r.choice(["on", "off", None])) for d in range(n_days) for e in ("a", "b", None)]


def test_history_in_one_pass_equals_batch_by_batch(spark):
    obs = observations()
    whole = state.scd2_build(frame(spark, "e string, ts timestamp, v string", obs), "e", "ts", "v")
    step = frame(spark, "e string, v string, valid_from timestamp, valid_to timestamp", [])
    for d in sorted({o[1] for o in obs}):
        inventory = frame(spark, "e string, v string", [(e, v) for e, t, v in obs if t == d])
        step = state.scd2_merge(step, inventory, "e", "v", F.lit(d).cast("timestamp"))
        step = spark.createDataFrame(step.collect(), step.schema)
    assert rows(step) == rows(whole.select(*step.columns))


def test_merge_closes_what_vanished_and_what_changed(spark):
    old = frame(spark, "e string, v string, valid_from timestamp, valid_to timestamp", [("gone", "1", ts(0), ts(1))]).unionByName(
        frame(spark, "e string, v string, valid_from timestamp", [("same", "1", ts(0)), ("gone", "2", ts(1)), ("new", "1", ts(0)), ("nil", None, ts(0))])
        .withColumn("valid_to", end()))
    inv = frame(spark, "e string, v string", [("same", "1"), ("new", "2"), ("nil", None)])
    got = state.scd2_merge(old, inv, "e", "v", F.lit(ts(9)).cast("timestamp")).withColumn("valid_to", F.nullif("valid_to", end()))
    assert set(rows(got, "e", "v", "valid_to")) == {("gone", "1", ts(1)), ("gone", "2", ts(9)), ("new", "1", ts(9)),
                                                   ("new", "2", None), ("nil", None, None), ("same", "1", None)}
    assert got.count() == 6


def test_history_shows_the_newer_value_and_only_living_entities(spark):
    st = frame(spark, "e string, key string, value string, valid_from timestamp, valid_to timestamp",
               [("a", "k", "1", ts(0), ts(1)), ("a", "k", "2", ts(1), ts(2)), ("dead", "k", "1", ts(0), ts(1)), ("a", "k", "", ts(-1), ts(0))])
    st = st.unionByName(frame(spark, "e string, key string, value string, valid_from timestamp", [("a", "k", "2", ts(3))]).withColumn("valid_to", end()))
    # The row closed at hour 2 equals the newer one: no change.
    got = state.state_history(st, "e", ignore_empty=True)
    assert rows(got, "value", "newer_value", "valid_to") == [("1", "2", ts(1)), ("2", None, None)]


def test_rollup_in_any_split_equals_one_shot(spark):
    r = random.Random(1)
    data = [(r.choice("ab"), ts(r.random() * 60), r.randrange(100), r.randrange(4)) for _ in range(200)]
    df = frame(spark, "k string, ts timestamp, s bigint, part int", data)
    merged = hourly_rollup(df.filter("part = 0"), "k", "ts", "s")
    for p in (1, 2, 3):
        merged = state.rollup_merge(merged, hourly_rollup(df.filter(f"part = {p}"), "k", "ts", "s"), ["k", "date", "hour"])
    assert rows(merged) == rows(hourly_rollup(df, "k", "ts", "s"))


def test_upsert_modes(spark):
    tgt = frame(spark, "k string, v int, kept string", [("a", 1, "x"), (None, 2, "y"), ("c", 3, "z")])
    src = frame(spark, "k string, v int", [("a", 9), (None, 2), ("new", 5)])
    assert rows(state.upsert(tgt, src, "k"), "k", "v", "kept") == [("a", 9, "x"), ("c", 3, "z"), ("new", 5, None), (None, 2, "y")]
    assert rows(state.upsert(tgt, src, "k", mode="insert_only"), "k", "v") == [("a", 1), ("c", 3), ("new", 5), (None, 2)]


def test_upsert_counts_changes(spark):
    tgt = frame(spark, "k string, v string, previous_value string, changes bigint", [("a", "1", None, 0), ("b", "1", "0", 4)])
    src = frame(spark, "k string, v string", [("a", "2"), ("b", "1"), ("c", "1")])
    assert rows(state.upsert_keep_previous(tgt, src, "k", "v")) == [("a", "2", "1", 1), ("b", "1", "0", 4), ("c", "1", None, 0)]


def test_retention_counts_from_the_newest_row_of_the_table(spark):
    df = frame(spark, "t string, ts timestamp", [("L", ts(0)), ("L", ts(24 * 4)), ("D", ts(0)), ("D", ts(24 * 10)), ("D", ts(-24 * 81))])
    got = state.apply_retention(df, "ts", [(90, None), (7, F.col("t") == "L")])
    assert rows(got, "t", "ts") == [("D", ts(0)), ("D", ts(24 * 10)), ("L", ts(24 * 4))]


def test_begin_end_pairs(spark):
    log = frame(spark, "id int, ts timestamp, kind string", [(1, ts(0), "b"), (1, ts(1), "e"), (2, ts(2), "b"), (3, ts(2), "e")])
    got = state.pair_begin_end(log, "id", "ts", F.col("kind") == "b", F.col("kind") == "e")
    assert rows(got, "id", "duration_ms") == [(1, 3_600_000), (2, None)]


def test_watermark_never_goes_back(spark):
    wm = frame(spark, "k string, ts timestamp", [("a", ts(5)), ("b", ts(1))])
    batch = frame(spark, "k string, ts timestamp", [("a", ts(3)), ("b", ts(2)), ("c", ts(0))])
    assert rows(state.advance_watermark(wm, batch, "k", "ts")) == [("a", ts(5)), ("b", ts(2)), ("c", ts(0))]


HIST = "job string, seq bigint, step int, status int, started timestamp, duration_s bigint"


def test_runs_take_the_worst_step_and_need_a_step(spark):
    hist = frame(spark, HIST, [
        ("j", 1, 1, 1, ts(0), 5), ("j", 2, 2, 0, ts(0), 5), ("j", 3, 0, 1, ts(0), 0),   # ok, but a step failed; 0 s
        ("j", 4, 0, 1, ts(1), 9),                                                       # no step before, none after
        ("j", 5, 0, 0, ts(2), 7), ("j", 6, 1, 1, ts(3), 2),                             # own failure; a step follows
        ("k", 7, 1, 1, ts(0), 1)])                                                      # never summarised
    for width in (2, 1000):
        got = runs.runs_from_history(hist, "job", "seq", "step", "status", "started", "duration_s", width=width)
        assert rows(got, "seq", "job_status", "steps_status", "duration_s") == [(3, 1, 0, 1), (5, 0, 0, 7)]


def test_failed_steps_look_at_the_run_before(spark):
    hist = frame(spark, HIST, [("j", 1, 1, 0, ts(0), 5), ("j", 2, 0, 1, ts(0), 44), ("j", 3, 1, 0, ts(1), 6), ("j", 4, 2, 4, ts(1), 6)])
    got = runs.failed_steps(hist, "job", "seq", "step", "status", "duration_s", by_range("seq", 2))
    assert rows(got, "seq", "job_duration_s") == [(3, 44)]


def test_missing_runs_are_marked_once_an_hour(spark):
    latest = frame(spark, "name string, started timestamp", [("a", ts(1)), ("b", ts(1)), ("c", ts(1)), ("a", ts(0))])
    delta = frame(spark, "name string, started timestamp", [("b", ts(1))])
    rollup = frame(spark, "name string, job_status int, steps_status int, date date, hour int", [("c", -1, -1, ts(1).date(), 1), ("a", 1, 1, ts(1).date(), 1)])
    assert rows(state.missing_run_markers(latest, delta, rollup), "name", "job_status", "duration_s") == [("a", -1, 0)]


def test_schedule_slots(spark):
    schema = ("job string, schedule_id int, freq_type int, freq_interval int, subday_type int, subday_interval int, recurrence int, "
              "start_date int, end_date int, start_time int, end_time int")
    df = frame(spark, schema, [("once", 1, 4, 1, 1, 0, 0, 20240101, 99991231, 63000, 235959), ("hourly", 2, 8, 62, 8, 2, 1, 20240101, 99991231, 80000, 130000),
                               ("old", 3, 4, 1, 1, 0, 0, 20200101, 20201231, 63000, 235959), ("never", 4, 4, 1, 8, 0, 0, 20240101, 99991231, 0, 235959)])
    got = runs.expand_schedule(df, F.lit("2024-06-01").cast("date"))
    assert rows(got, "job", "hour_slot") == [("hourly", 8), ("hourly", 10), ("hourly", 12), ("once", 6)]
    text = {r.job: r for r in got.collect()}
    assert text["hourly"].day_text == "Mon\nTue\nWed\nThu\nFri" and text["hourly"].detail_text == "Every 2 hours between 08:00:00 and 13:00:00"
    assert text["once"].when_text == "Every day" and text["once"].active_text == "Starting on 2024-01-01"
