"""M: streams fed in order, shuffled within the delay, and late beyond it."""

import os
import random
from datetime import datetime
from functools import partial

import pytest
from helpers import frame, rows, ts
from pyspark.sql import functions as F

from pulsemill.operators.chunked import newest_per_group
from pulsemill.operators.counters import counter_delta
from pulsemill.operators.state import scd2_build, scd2_merge
from pulsemill.sources.event_files import event_file_stream
from pulsemill.streaming import streams


def feed(spark, path, schema, batches):
    for b in batches:
        frame(spark, schema, b).coalesce(1).write.mode("append").parquet(path)
    return event_file_stream(spark, path, schema, max_files=1)


SNAP = "k string, ts timestamp, n bigint, epoch timestamp"


def counter_rows():
    r = random.Random(2)
    return [(k, ts(0, minutes=10 * i), r.randrange(1000), ts(-1 if i < 20 else 3)) for i in range(40) for k in ("a", "b", None)]


def run_delta(spark, tmp_path, batches, delay_s):
    p = {n: str(tmp_path / n) for n in ("src", "out", "state", "ck")}
    s = feed(spark, p["src"], SNAP, batches)
    streams.stream_counter_delta(s, "k", "ts", ["n"], p["out"], p["state"], p["ck"], delay_s=delay_s, epoch="epoch",
                                 drop_zero=False).awaitTermination()
    return rows(spark.read.parquet(p["out"]), "k", "ts", "delta_n")


def batch_delta(spark, data):
    return rows(counter_delta(frame(spark, SNAP, data), "k", "ts", ["n"], epoch="epoch", drop_zero=False), "k", "ts", "delta_n")


def test_counter_delta_in_order(spark, tmp_path):
    data = counter_rows()
    assert run_delta(spark, tmp_path, [data[:30], data[30:75], data[75:]], 0) == batch_delta(spark, data)


def test_counter_delta_out_of_order_within_the_delay(spark, tmp_path):
    data = counter_rows()
    # Neighbouring rows swap batches: up to 3 stamps (30 minutes) apart.
    batches = [data[:27] + data[30:33], data[27:30] + data[33:60] + data[66:69], data[60:66] + data[69:]]
    flush = [("z", ts(200), 0, ts(3))]
    got = run_delta(spark, tmp_path, [*batches, flush], 3600)
    assert got == batch_delta(spark, data)  # z itself still waits


def test_counter_delta_drops_rows_beyond_the_delay(spark, tmp_path):
    data = [("a", ts(0), 5, ts(-1)), ("a", ts(10), 9, ts(-1)), ("a", ts(20), 20, ts(-1))]
    late = ("a", ts(5), 7, ts(-1))
    got = run_delta(spark, tmp_path, [data[:2], [late, data[2]]], 0)
    assert got == batch_delta(spark, data)


def test_a_poll_split_over_batches_loses_nothing(spark, tmp_path):
    data = [(k, ts(i), i * 10 + j, ts(-1)) for i in range(3) for j, k in enumerate("ab")]
    by_entity = [[r for r in data if r[0] == k and r[1] == ts(i)] for i in range(3) for k in "ab"]
    assert run_delta(spark, tmp_path, by_entity, 0) == batch_delta(spark, data)


def test_late_rows_are_kept_aside(spark, tmp_path):
    data = [("a", ts(0), 5, ts(-1)), ("a", ts(10), 9, ts(-1))]
    run_delta(spark, tmp_path, [data, [("a", ts(5), 7, ts(-1)), ("a", ts(10), 9, ts(-1)), ("b", ts(5), 1, ts(-1))]], 0)
    assert rows(spark.read.parquet(str(tmp_path / "state" / "late")), "k", "ts") == [("a", ts(5)), ("a", ts(10))]


def test_silent_entities_expire(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("src", "out", "state", "ck")}
    data = [[("a", ts(0), 5, ts(-1)), ("b", ts(0), 5, ts(-1))], [("b", ts(30), 6, ts(-1))], [("a", ts(31), 9, ts(-1)), ("b", ts(31), 8, ts(-1))]]
    streams.stream_counter_delta(feed(spark, p["src"], SNAP, data), "k", "ts", ["n"], p["out"], p["state"], p["ck"], epoch="epoch",
                                 expire_s=24 * 3600, drop_zero=False).awaitTermination()
    # a was forgotten after a day and starts over; b has its gap of 30 hours counted.
    assert rows(spark.read.parquet(p["out"]).filter("ts > '2024-01-02'"), "k", "delta_n") == [("a", None), ("b", 1), ("b", 2)]


def test_dedup_within_the_delay(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("src", "out", "ck")}
    schema = "id int, ts timestamp"
    s = feed(spark, p["src"], schema, [[(1, ts(0)), (1, ts(0)), (2, ts(0))], [(2, ts(0)), (3, ts(1))]])
    streams.run_to_end(streams.stream_dedup(s, "id", "ts", "2 hours"), p["out"], p["ck"]).awaitTermination()
    assert rows(spark.read.parquet(p["out"]), "id") == [(1,), (2,), (3,)]


def test_rollup_updates_late_rows_within_the_delay_and_drops_later_ones(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("src", "out", "ck")}
    schema = "k string, ts timestamp, v bigint"
    s = feed(spark, p["src"], schema, [
        [("a", ts(0.5), 1)], [("a", ts(2.5), 10)],
        [("a", ts(0.6), 2)],       # two hours late: the hour is still open
        [("a", ts(30), 100)], [("a", ts(30), 100)],  # Spark drops by the watermark of the batch before
        [("a", ts(0.7), 4)]])      # a day late: dropped
    out = streams.stream_rollup(s, "k", "ts", "v", "3 hours")
    streams.run_to_end(out, p["out"], p["ck"], "update").awaitTermination()
    newest = newest_per_group(spark.read.parquet(p["out"]), ["k", "hour_start"], "batch_id")
    assert rows(newest, "hour_start", "cnt", "sum_s", "min_s", "max_s") == [(ts(0), 2, 3, 1, 2), (ts(2), 1, 10, 10, 10), (ts(30), 2, 200, 100, 100)]


def test_silent_entities(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("src", "out", "ck")}
    s = feed(spark, p["src"], "k string, ts timestamp", [[("a", ts(0)), ("b", ts(0)), ("a", ts(1))], [("b", ts(2)), ("b", ts(5))], [("b", ts(9.5))]])
    streams.run_to_end(streams.stream_missing_heartbeat(s, "k", "ts", "4 hours", "0 seconds"), p["out"], p["ck"]).awaitTermination()
    assert rows(spark.read.parquet(p["out"]), "k", "last_seen") == [("a", ts(1)), ("b", ts(5))]


def test_history_of_a_stream_equals_one_pass(spark, tmp_path):
    r = random.Random(4)
    data = [(k, ts(i), r.choice("xyz")) for i in range(30) for k in ("a", None)]
    schema = "k string, ts timestamp, v string"
    p = {n: str(tmp_path / n) for n in ("src", "hist", "ck")}
    q = streams.stream_scd2(feed(spark, p["src"], schema, [data[:20], data[20:22], data[22:]]), "k", "ts", "v", p["hist"], p["ck"])
    q.awaitTermination()
    got = streams.StreamedHistory(p["hist"]).read(spark, q.lastProgress["batchId"])
    want = scd2_build(frame(spark, schema, data), "k", "ts", "v")
    assert rows(got, "k", "v", "valid_from", "valid_to") == rows(want, "k", "v", "valid_from", "valid_to")


def history_of(spark, tmp_path, batches, **options):
    p = {n: str(tmp_path / n) for n in ("src", "hist", "ck")}
    q = streams.stream_scd2(feed(spark, p["src"], "k string, ts timestamp, v string", batches), "k", "ts", "v", p["hist"], p["ck"], **options)
    q.awaitTermination()
    return rows(streams.StreamedHistory(p["hist"]).read(spark, q.lastProgress["batchId"]), "k", "v", "valid_from", "valid_to"), p["hist"]


def test_late_observations_leave_no_overlap(spark, tmp_path):
    got, folder = history_of(spark, tmp_path, [[("k", ts(10), "A"), ("k", ts(20), "B")], [("k", ts(15), "C"), ("m", ts(15), "D")], [("k", ts(30), "B")], [("k", ts(25), "A")]])
    end = datetime(9999, 12, 31, 23, 59, 59)
    assert got == [("k", "A", ts(10), ts(20)), ("k", "B", ts(20), end), ("m", "D", ts(15), end)]
    # The one at 25 is late although nothing changed at 30.
    assert rows(spark.read.parquet(f"{folder}/late"), "k", "observed_at", "v") == [("k", ts(15), "C"), ("k", ts(25), "A")]


def test_observations_within_the_delay_are_put_in_order(spark, tmp_path):
    data = [("k", ts(i), v) for i, v in enumerate("AABBCAAD")]
    got, _ = history_of(spark, tmp_path, [[data[1], data[0], data[3]], [data[2], data[5]], [data[4], data[6]], [data[7]], [("z", ts(99), "Z")]], delay_s=3 * 3600)
    want = scd2_build(frame(spark, "k string, ts timestamp, v string", data), "k", "ts", "v")
    assert got == rows(want, "k", "v", "valid_from", "valid_to")


STATE = "k string, v int"


def test_a_log_of_keyed_state_equals_a_table_rewritten_each_batch(spark, tmp_path):
    r = random.Random(7)
    state, want, root = streams.KeyedState(str(tmp_path / "s"), buckets=8, every=3), {}, tmp_path / "s"
    for batch in range(8):
        changed = {r.choice([None, *"abcdefghij"]): r.randrange(99) for _ in range(3)} if batch != 4 else {}
        asked = [*changed, "unknown"]
        got = state.before(frame(spark, STATE, []), ["k"], batch, frame(spark, "k string", [(k,) for k in asked]))
        assert rows(got, "k", "v") == rows(frame(spark, STATE, [(k, want[k]) for k in changed if k in want]), "k", "v")
        for _ in range(1 + batch % 2):  # every second batch runs twice
            state.write(frame(spark, STATE, list(changed.items())), ["k"], batch)
        want |= changed
        assert rows(state.read(spark, lambda c: c[:1], batch)) == rows(frame(spark, STATE, list(want.items())))
        # Only a whole folder holds more than the batch changed.
        written = spark.read.parquet(str(root / f"batch={batch}")).count()
        assert written == (len(want) if batch % 3 == 0 else len(changed))
    assert sorted(os.listdir(root)) == sorted(f"batch={b}" for b in range(3, 8))


def test_a_batch_reads_and_writes_the_buckets_of_its_keys(spark, tmp_path):
    state = streams.KeyedState(str(tmp_path / "s"))
    state.write(spark.range(20000).selectExpr("cast(id AS string) AS k", "cast(id AS int) AS v"), ["k"], 0)
    size = lambda b: sum(f.stat().st_size for f in (tmp_path / "s" / f"batch={b}").glob("*.parquet"))
    state.write(frame(spark, STATE, [("7", 1)]), ["k"], 1)
    assert size(1) < size(0) / 20
    got = state.before(frame(spark, STATE, []), ["k"], 2, frame(spark, "k string", [("7",), ("8",)]))
    assert rows(got) == [("7", 1), ("8", 8)]
    assert "PushedFilters: [In(state_bucket" in got._jdf.queryExecution().toString()


def test_deltas_and_histories_over_whole_folders_and_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "KeyedState", partial(streams.KeyedState, buckets=4, every=2))
    data = counter_rows()
    p = {n: str(tmp_path / n) for n in ("src", "out", "state", "ck")}
    for part in (data[:60], data[60:]):
        s = feed(spark, p["src"], SNAP, [part[:31], part[31:]])
        streams.stream_counter_delta(s, "k", "ts", ["n"], p["out"], p["state"], p["ck"], epoch="epoch", drop_zero=False).awaitTermination()
    assert rows(spark.read.parquet(p["out"]), "k", "ts", "delta_n") == batch_delta(spark, data)
    r = random.Random(5)
    seen = [(k, ts(i), r.choice("xy")) for i in range(12) for k in ("a", "b", None)]
    got, _ = history_of(spark, tmp_path / "h", [seen[i:i + 13] for i in range(0, len(seen), 13)])
    assert got == rows(scd2_build(frame(spark, "k string, ts timestamp, v string", seen), "k", "ts", "v"), "k", "v", "valid_from", "valid_to")


def test_marks_of_silent_keys_expire_and_older_observations_are_late(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "KeyedState", partial(streams.KeyedState, every=1))
    got, folder = history_of(spark, tmp_path, [
        [("a", ts(0), "A"), ("b", ts(0), "B")], [("b", ts(30), "C")],
        [("a", ts(3), "X"), ("n", ts(3), "N"), ("b", ts(31), "C")],  # before the limit: late, even for a new key
        [("a", ts(32), "D")]], expire_s=24 * 3600)
    end = datetime(9999, 12, 31, 23, 59, 59)
    assert got == [("a", "A", ts(0), ts(32)), ("a", "D", ts(32), end), ("b", "B", ts(0), ts(30)), ("b", "C", ts(30), end)]
    assert rows(spark.read.parquet(f"{folder}/late"), "k", "v") == [("a", "X"), ("n", "N")]
    assert rows(spark.read.parquet(f"{folder}/last/batch=2"), "k") == [("b",)]


@pytest.mark.parametrize("hold", [True, False])
def test_streamed_inventories_close_vanished_keys(spark, tmp_path, hold):
    polls = [[("a", "1", ts(0)), ("b", "1", ts(0))], [("a", "2", ts(1))], [("a", "2", ts(2)), ("b", "1", ts(2)), ("c", None, ts(2))], [("a", "2", ts(3))]]
    # With the newest poll held, a poll may be split; without, a batch holds whole polls.
    batches = [polls[0][:1], polls[0][1:] + polls[1], polls[2][:1], polls[2][1:], polls[3]] if hold else [polls[0] + polls[1], polls[2], polls[3]]
    p = {n: str(tmp_path / n) for n in ("src", "hist", "ck")}
    s = feed(spark, p["src"], "k string, v string, ts timestamp", batches)
    q = streams.stream_inventory(s, "k", "ts", "v", p["hist"], p["ck"], hold_newest=hold)
    q.awaitTermination()
    want = frame(spark, "k string, v string, valid_from timestamp, valid_to timestamp", [])
    for poll in polls[:3] if hold else polls:
        inv = frame(spark, "k string, v string, ts timestamp", poll)
        want = scd2_merge(want, inv.drop("ts"), "k", "v", F.lit(poll[0][2]).cast("timestamp"))
        want = spark.createDataFrame(want.collect(), want.schema)
    got = streams.StreamedHistory(p["hist"]).read(spark, q.lastProgress["batchId"])
    assert rows(got, "k", "v", "valid_from", "valid_to") == rows(want, "k", "v", "valid_from", "valid_to")


def test_snapshot_sink_is_partitioned_by_day(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("src", "out", "ck")}
    s = feed(spark, p["src"], "v int, ts_utc timestamp", [[(1, ts(0)), (2, ts(30))]])
    streams.stream_snapshot_sink(s, p["out"], p["ck"]).awaitTermination()
    assert rows(spark.read.parquet(p["out"]).filter("date = '2024-01-02'"), "v") == [(2,)]
