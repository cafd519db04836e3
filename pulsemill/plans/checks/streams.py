"""Streaming forms: M.  Each drains the events file and reads the sink back."""

from pyspark.sql import Column, DataFrame, functions as F

from ...operators.chunked import newest_per_group
from ...session import scratch_dir
from ...sources.event_files import event_file_stream
from ...streaming import streams
from . import ORDER_STATES, SNAPSHOTS, at, check, day


def _events(t) -> DataFrame:
    return event_file_stream(t.spark, t.folder, t.events.schema, pathGlobFilter="events.parquet")


FILES = 4


def _stream_of(t, df: DataFrame, label: str, slices: Column, count: int, keys, per_batch: int = FILES) -> DataFrame:
    """Stream ``df`` slice by slice, each slice in a few files.

    A slice's rows go to files by the hash of ``keys``, so what is together
    by key stays in order.  ``per_batch`` files make a batch: with fewer than
    a slice has, its rows come in several batches.
    """
    path = scratch_dir(t.spark, label)
    sliced = df.withColumn("_slice", slices)
    # One append per slice, so the files of a slice are newer than those before.
    for i in range(count):
        part = sliced.filter(F.col("_slice") == i).drop("_slice")
        part.repartition(FILES, *keys).write.mode("append").parquet(path)
    return event_file_stream(t.spark, path, df.schema, max_files=per_batch)


def _thirds_of_month(ts: str) -> Column:
    return F.least(F.floor(F.dayofmonth(ts) / 11), F.lit(2))


def _eras(ts: str) -> Column:
    return F.when(F.year(ts) < 1997, 0).when(F.year(ts) < 2000, 1).otherwise(2)


_DELTAS = f"""WITH {SNAPSHOTS},
p AS (SELECT *, lag(total) OVER w AS p_total, lag(hits) OVER w AS p_hits, lag(epoch) OVER w AS p_epoch, lag(ts) OVER w AS p_ts FROM snap WINDOW w AS (PARTITION BY entity ORDER BY ts)),
d AS (SELECT entity, ts, CASE WHEN date_diff('hour', p_ts, ts) > 12 OR p_total IS NULL THEN NULL WHEN p_total > total OR p_epoch <> epoch THEN total ELSE total - p_total END AS delta_total,
CASE WHEN date_diff('hour', p_ts, ts) > 12 OR p_hits IS NULL THEN NULL WHEN p_hits > hits OR p_epoch <> epoch THEN hits ELSE hits - p_hits END AS delta_hits FROM p)
SELECT entity, {at('ts')} AS ts, delta_total, delta_hits FROM d WHERE delta_total <> 0 OR delta_hits <> 0"""


def _delta_stream(t, per_batch: int) -> DataFrame:
    root = scratch_dir(t.spark, "delta")
    rows = t.snapshots.select("entity", "ts", "epoch", "total", "hits")
    s = _stream_of(t, rows, "snapshots", _thirds_of_month("ts"), 3, ["entity"], per_batch)
    streams.stream_counter_delta(s, "entity", "ts", ["total", "hits"], f"{root}/out", f"{root}/state", f"{root}/checkpoint",
                                 epoch="epoch", max_gap=12).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("entity", "ts", "delta_total", "delta_hits")


@check("m1_stream_counter_delta", _DELTAS)
def _(t):
    return _delta_stream(t, FILES)


@check("m1_stream_split_poll", _DELTAS)
def _(t):
    """Every batch has some entities' rows only, so all polls are split."""
    return _delta_stream(t, 1)


@check("m2_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    root = scratch_dir(t.spark, "dedup")
    twice = _events(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = streams.stream_dedup(twice, ["event_id"], "ts", "1 hour").select("user_id", "event_type", "event_id")
    streams.run_to_end(out, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@check("m3_stream_rollup", f"""SELECT event_type, {at("date_trunc('hour', ts)")} AS hour_start, count(*) AS cnt, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sum_s,
min(CAST(round(value * 100) AS BIGINT)) AS min_s, max(CAST(round(value * 100) AS BIGINT)) AS max_s FROM events GROUP BY 1, 2""")
def _(t):
    root = scratch_dir(t.spark, "rollup")
    e = _stream_of(t, t.events, "events", _thirds_of_month("ts"), 3, ["event_id"]).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    out = streams.stream_rollup(e, "event_type", "ts", "cents", "2 hours")
    streams.run_to_end(out, f"{root}/out", f"{root}/checkpoint", "update").awaitTermination()
    rows = t.spark.read.parquet(f"{root}/out")
    return newest_per_group(rows, ["event_type", "hour_start"], "batch_id").drop("batch_id")


_HISTORY_OF = f"""seen AS (SELECT *, lag(value) OVER (PARTITION BY entity, key ORDER BY ts, seq) AS was FROM taken),
ch AS (SELECT *, lead(ts) OVER (PARTITION BY entity, key ORDER BY ts, seq) AS nxt FROM seen WHERE was IS NULL OR was <> value)
SELECT entity, key, value, {at('ts')} AS valid_from, {at("coalesce(nxt, TIMESTAMP '9999-12-31 23:59:59')")} AS valid_to FROM ch"""


def _streamed_history(t, slices: Column) -> DataFrame:
    root = scratch_dir(t.spark, "scd2")
    s = _stream_of(t, t.order_states, "states", slices, 3, ["entity", "key"])
    q = streams.stream_scd2(s, ["entity", "key"], "ts", "value", f"{root}/history", f"{root}/checkpoint", ["seq"])
    q.awaitTermination()
    return streams.StreamedHistory(f"{root}/history").read(t.spark, q.lastProgress["batchId"])


@check("m4_stream_scd2", f"WITH {ORDER_STATES}, taken AS (SELECT * FROM obs), {_HISTORY_OF}")
def _(t):
    return _streamed_history(t, _eras("ts"))


@check("m4_stream_late", f"""WITH {ORDER_STATES},
sent AS (SELECT *, least(2, CASE WHEN year(ts) < 1997 THEN 0 WHEN year(ts) < 2000 THEN 1 ELSE 2 END + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) AS slice FROM obs),
lasts AS (SELECT entity, key, slice, max({{'ts': ts, 'seq': seq}}) AS last FROM sent GROUP BY 1, 2, 3),
taken AS (SELECT * FROM sent s WHERE NOT EXISTS (SELECT 1 FROM lasts l WHERE l.entity = s.entity AND l.key = s.key AND l.slice < s.slice AND l.last >= {{'ts': s.ts, 'seq': s.seq}})),
{_HISTORY_OF}""")
def _(t):
    """Every fifth observation comes an era late; those that come after newer ones of their key are left out."""
    return _streamed_history(t, F.least(F.lit(2), _eras("ts") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0)))


@check("m4_stream_inventory", f"""WITH inv AS (SELECT o_custkey AS entity, make_timestamp(1995 + (year(o_orderdate) - 1995) // 2 * 2, 1, 1, 0, 0, 0) AS ts, max(o_orderpriority) AS value FROM orders
  WHERE (year(o_orderdate) - 1995) // 2 < (SELECT max((year(o_orderdate) - 1995) // 2) FROM orders) GROUP BY 1, 2),
runs AS (SELECT *, sum(CASE WHEN was = value AND before + INTERVAL 2 YEAR = ts THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY ts) AS run
  FROM (SELECT *, lag(value) OVER w AS was, lag(ts) OVER w AS before FROM inv WINDOW w AS (PARTITION BY entity ORDER BY ts))),
spans AS (SELECT entity, value, min(ts) AS valid_from, max(ts) AS last FROM runs GROUP BY entity, value, run)
SELECT entity, value, {at('valid_from')} AS valid_from,
{at("CASE WHEN last = (SELECT max(ts) FROM inv) THEN TIMESTAMP '9999-12-31 23:59:59' ELSE CAST(last + INTERVAL 2 YEAR AS TIMESTAMP) END")} AS valid_to FROM spans""")
def _(t):
    """A poll for every two years, in several batches: customers with orders then and their highest priority.

    The newest poll waits for a later one.
    """
    root = scratch_dir(t.spark, "inventory")
    poll = F.floor((F.year("o_orderdate") - 1995) / 2)
    stamp = F.make_date((poll * 2 + 1995).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    polls = t.orders.groupBy(F.col("o_custkey").alias("entity"), stamp.alias("ts")).agg(F.max("o_orderpriority").alias("value"))
    s = _stream_of(t, polls, "polls", F.floor((F.year("ts") - 1995) / 2), 4, ["entity"], 3)
    q = streams.stream_inventory(s, "entity", "ts", "value", f"{root}/history", f"{root}/checkpoint")
    q.awaitTermination()
    return streams.StreamedHistory(f"{root}/history").read(t.spark, q.lastProgress["batchId"]).select("entity", "value", "valid_from", "valid_to")


@check("m5_stream_missing_heartbeat", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new_run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new_run) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g),
s AS (SELECT user_id, run, max(ts) AS last_seen, count(*) AS events FROM r GROUP BY 1, 2)
SELECT user_id, {at('last_seen')} AS last_seen, {at('last_seen + INTERVAL 24 HOUR')} AS silent_since, events FROM s WHERE last_seen + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    root = scratch_dir(t.spark, "heartbeat")
    out = streams.stream_missing_heartbeat(_events(t), "user_id", "ts", "24 hours", "1 hour")
    streams.run_to_end(out, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out")


@check("m6_stream_snapshot_sink", f"SELECT {day('ts')} AS date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(t):
    root = scratch_dir(t.spark, "sink")
    streams.stream_snapshot_sink(_events(t), f"{root}/out", f"{root}/checkpoint", "ts").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
