"""Counter deltas and windows: I, F, D6, D7."""

from pyspark.sql import functions as F

from ...operators import aggregate, chunked, counters, joins
from . import SNAPSHOTS, at, check

_KEEP = "entity, ts, delta_total, delta_hits"


def _delta_sql(where: str, total: str, hits: str, prev: str = "") -> str:
    return f"""WITH {SNAPSHOTS},
p AS (SELECT *, lag(total) OVER w AS p_total, lag(hits) OVER w AS p_hits, lag(epoch) OVER w AS p_epoch,
  lag(ts) OVER w AS p_ts, lag(sample_ms) OVER w AS p_ms FROM snap WINDOW w AS (PARTITION BY entity ORDER BY ts)),
{prev}
d AS (SELECT entity, ts, {total} AS delta_total, {hits} AS delta_hits FROM {'q' if prev else 'p'})
SELECT entity, {at('ts')} AS ts, delta_total, delta_hits FROM d {where}"""


def _case(c: str, null: str, first: str, reset: str) -> str:
    return f"CASE WHEN {null} THEN NULL WHEN p_{c} IS NULL THEN {first} WHEN {reset} OR p_{c} > {c} THEN {c} ELSE {c} - p_{c} END"


_ZERO = "WHERE delta_total <> 0 OR delta_hits <> 0"
_PREV_STAMP = """stamps AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_stamp FROM (SELECT DISTINCT ts FROM snap)),
q AS (SELECT s.entity, s.ts, s.total, s.hits, s.epoch, b.total AS p_total, b.hits AS p_hits, b.epoch AS p_epoch, b.ts AS p_ts
  FROM snap s JOIN stamps USING (ts) {how} JOIN snap b ON b.entity = s.entity AND b.ts = prev_stamp),"""


def _two(null, first, reset):
    return _case("total", null, first, reset), _case("hits", null, first, reset)


@check("i1_counter_delta_row", _delta_sql(_ZERO, *_two("date_diff('hour', p_ts, ts) > 12", "NULL", "p_epoch <> epoch")))
def _(t):
    return counters.counter_delta(t.snapshots, "entity", "ts", ["total", "hits"], epoch="epoch", max_gap=12).select(*_KEEP.split(", "))


@check("i1_counter_delta_keep_zero", _delta_sql("", *_two("false", "NULL", "false")))
def _(t):
    return counters.counter_delta(t.snapshots, "entity", "ts", ["total", "hits"], drop_zero=False).select(*_KEEP.split(", "))


@check("i1_counter_delta_clock", _delta_sql(_ZERO, *_two("false", "NULL", "p_ms > sample_ms")))
def _(t):
    return counters.counter_delta(t.snapshots, "entity", "ts", ["total", "hits"], clock="sample_ms").select(*_KEEP.split(", "))


@check("i1_counter_delta_gap_or_equal", _delta_sql(_ZERO, *_two("date_diff('hour', p_ts, ts) >= 3", "total", "p_epoch <> epoch")).replace("WHEN p_hits IS NULL THEN total", "WHEN p_hits IS NULL THEN hits"))
def _(t):
    return counters.counter_delta(t.snapshots, "entity", "ts", ["total", "hits"], epoch="epoch", max_gap=3, gap_op=">=",
                                  first="value").select(*_KEEP.split(", "))


@check("i1_counter_delta_snapshot_inner", _delta_sql(_ZERO, *_two("false", "NULL", "p_epoch <> epoch"), _PREV_STAMP.format(how="INNER")))
def _(t):
    return counters.counter_delta(t.snapshots, "entity", "ts", ["total", "hits"], epoch="epoch", prev="snapshot",
                                  first="absent").select(*_KEEP.split(", "))


@check("i1_counter_delta_snapshot_left", _delta_sql(_ZERO, *_two("date_diff('hour', p_ts, ts) >= 12", "total", "p_epoch <> epoch"), _PREV_STAMP.format(how="LEFT")).replace("WHEN p_hits IS NULL THEN total", "WHEN p_hits IS NULL THEN hits"))
def _(t):
    return counters.counter_delta(t.snapshots, "entity", "ts", ["total", "hits"], epoch="epoch", prev="snapshot", first="value",
                                  max_gap=12, gap_op=">=").select(*_KEEP.split(", "))


@check("i2_latency", f"""WITH {SNAPSHOTS},
p AS (SELECT *, lag(total) OVER w AS p_total, lag(hits) OVER w AS p_hits, lag(sample_ms) OVER w AS p_ms FROM snap WINDOW w AS (PARTITION BY entity ORDER BY ts)),
d AS (SELECT entity, ts, {_case('total', 'false', 'NULL', 'p_ms > sample_ms')} AS a, {_case('hits', 'false', 'NULL', 'p_ms > sample_ms')} AS b FROM p)
SELECT entity, {at('ts')} AS ts, a / nullif(CAST(b AS DOUBLE), 0) AS latency FROM d WHERE a <> 0 OR b <> 0""")
def _(t):
    d = counters.counter_delta(t.snapshots, "entity", "ts", ["total", "hits"], clock="sample_ms")
    return counters.with_latency(d, "delta_total", "delta_hits", "latency").select("entity", "ts", "latency")


@check("i3_delta_from_first", f"""WITH s AS (SELECT user_id AS session, date_trunc('day', ts) AS login, event_id, ts, event_type,
  CAST(round(value * 100) AS BIGINT) AS cpu FROM events),
f AS (SELECT *, first_value(cpu) OVER (PARTITION BY session, login ORDER BY ts) AS first_cpu FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY session, login ORDER BY ts DESC) AS rn FROM f
  WHERE event_type <> 'view' AND date_diff('hour', ts, (SELECT max(ts) FROM s)) < 240)
SELECT session, {at('login')} AS login, event_id, cpu - first_cpu AS delta_cpu,
  date_diff('second', ts, (SELECT max(ts) FROM s)) AS seconds_since_last_seen FROM n WHERE rn = 1""")
def _(t):
    s = t.events.select(F.col("user_id").alias("session"), F.date_trunc("day", "ts").alias("login"), "event_id", "ts",
                        "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cpu"))
    out = counters.delta_from_first(s, ["session", "login"], "ts", ["cpu"], keep=F.col("event_type") != "view", hours=240)
    return out.select("session", "login", "event_id", "delta_cpu", "seconds_since_last_seen")


_PERF_SQL = """
h AS (SELECT user_id % 10 AS inst, event_type, date_trunc('minute', ts) - INTERVAL (minute(ts) % 30) MINUTE AS ts,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3),
perf AS (SELECT CASE event_type WHEN 'click' THEN 'Reads/sec' WHEN 'view' THEN 'Wait Time (ms)' WHEN 'error' THEN 'Hit Ratio' ELSE event_type END AS counter,
    'i' || inst AS instance, ts, v AS value,
    CASE event_type WHEN 'click' THEN 272696576 WHEN 'view' THEN 1073874176 WHEN 'error' THEN 537003264 ELSE 65792 END AS type FROM h
  UNION ALL SELECT CASE event_type WHEN 'view' THEN 'Wait Time Base' ELSE 'Hit Ratio Base' END, 'i' || inst, ts, n, 1073939712
  FROM h WHERE event_type IN ('view', 'error')),
stamps AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM (SELECT DISTINCT ts FROM perf)),
d AS (SELECT a.*, a.value - b.value AS gain, date_diff('second', stamps.prev, a.ts) AS secs FROM perf a JOIN stamps USING (ts)
  JOIN perf b ON b.ts = stamps.prev AND b.counter = a.counter AND b.instance = a.instance
  WHERE date_diff('minute', stamps.prev, a.ts) BETWEEN 1 AND 60),
base AS (SELECT *, upper(rtrim(left(counter, strpos(upper(counter), 'BASE') - 1))) AS j FROM d WHERE type = 1073939712 AND value <> 0),
a AS (SELECT counter, instance, ts, CAST(value AS DOUBLE) AS cooked FROM d WHERE type = 65792
  UNION ALL SELECT counter, instance, ts, CAST(trunc(gain / CAST(secs AS DOUBLE)) AS DOUBLE) FROM d WHERE type = 272696576
  UNION ALL SELECT d.counter, d.instance, d.ts, CAST(trunc(d.gain / CAST(base.value AS DOUBLE)) AS DOUBLE) FROM d JOIN base ON base.ts = d.ts AND base.instance = d.instance
    AND base.j = upper(rtrim(split_part(d.counter, '(', 1))) WHERE d.type = 1073874176
  UNION ALL SELECT d.counter, d.instance, d.ts, round(d.value / CAST(base.value AS DOUBLE), 3) FROM d JOIN base ON base.ts = d.ts AND base.instance = d.instance
    AND base.j = upper(d.counter) WHERE d.type = 537003264)"""


def _perf(t):
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 1800) * 1800)
    h = t.events.groupBy((F.col("user_id") % 10).alias("inst"), "event_type", slot.alias("ts_utc")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"), F.count(F.lit(1)).alias("n"))
    kind = F.col("event_type")
    named = lambda a, b, c, rest: F.when(kind == "click", a).when(kind == "view", b).when(kind == "error", c).otherwise(rest)
    instance = F.concat(F.lit("i"), F.col("inst").cast("string")).alias("instance")
    main = h.select(F.lit("obj").alias("object"), named("Reads/sec", "Wait Time (ms)", "Hit Ratio", kind).alias("counter"),
                    instance, F.col("v").alias("value"), named(272696576, 1073874176, 537003264, 65792).alias("type"), "ts_utc")
    base = h.filter(kind.isin("view", "error")).select(
        F.lit("obj").alias("object"), F.when(kind == "view", "Wait Time Base").otherwise("Hit Ratio Base").alias("counter"),
        instance, F.col("n").alias("value"), F.lit(1073939712).alias("type"), "ts_utc")
    return main.unionByName(base)


@check("i4_cook_counters", f"WITH {_PERF_SQL} SELECT counter, instance, {at('ts')} AS ts, CASE WHEN cooked >= 0 THEN cooked + 0.0 END AS cooked_value FROM a")
def _(t):
    return counters.cook_counters(_perf(t)).select("counter", "instance", F.col("ts_utc").alias("ts"), "cooked_value")


@check("i5_ratio_at_stamp", f"""WITH {SNAPSHOTS},
x AS (SELECT entity % 4 AS grp, ts, max(CASE WHEN entity < 10 THEN total END) AS num, max(CASE WHEN entity >= 10 THEN hits * 10 END) AS den FROM snap GROUP BY 1, 2)
SELECT grp, {at('ts')} AS ts, (CASE WHEN num = 0 THEN 1 ELSE num END) / nullif(CAST(den AS DOUBLE), 0) AS ratio FROM x WHERE num IS NOT NULL AND den IS NOT NULL""")
def _(t):
    s = t.snapshots.withColumns({"grp": F.col("entity") % 4,
                                 "value": F.when(F.col("entity") < 10, F.col("total")).otherwise(F.col("hits") * 10)})
    return counters.ratio_at_stamp(s, "grp", "ts", "value", F.col("entity") < 10, F.col("entity") >= 10)


@check("i6_query_deltas", f"""WITH {SNAPSHOTS},
stamps AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_stamp FROM (SELECT DISTINCT ts FROM snap)),
q AS (SELECT s.entity, s.ts, s.total, s.hits, s.epoch, b.total AS p_total, b.hits AS p_hits, b.epoch AS p_epoch, b.ts AS p_ts
  FROM snap s JOIN stamps USING (ts) LEFT JOIN snap b ON b.entity = s.entity AND b.ts = prev_stamp),
d AS (SELECT entity, ts, {_case('total', "date_diff('hour', p_ts, ts) >= 12", 'total', 'p_epoch <> epoch')} AS a,
  {_case('hits', "date_diff('hour', p_ts, ts) >= 12", 'hits', 'p_epoch <> epoch')} AS b FROM q)
SELECT entity % 5 AS query, {at('ts')} AS ts, CAST(sum(a) AS BIGINT) AS total, CAST(sum(b) AS BIGINT) AS hits FROM d WHERE a <> 0 OR b <> 0 GROUP BY 1, 2""")
def _(t):
    s = t.snapshots.withColumn("query", F.col("entity") % 5)
    return counters.query_deltas(s, "query", "entity", "ts", ["total", "hits"], epoch="epoch")


@check("d6_previous_snapshot_join", f"""WITH {SNAPSHOTS},
stamps AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_stamp FROM (SELECT DISTINCT ts FROM snap))
SELECT s.entity, {at('s.ts')} AS ts, s.total, b.total AS was FROM snap s JOIN stamps USING (ts) JOIN snap b ON b.entity = s.entity AND b.ts = prev_stamp""")
def _(t):
    return joins.previous_snapshot_join(t.snapshots, "entity", "ts", {"was": "total"}).select("entity", "ts", "total", "was")


@check("d7_asof_previous", f"""WITH {SNAPSHOTS}
SELECT entity, {at('ts')} AS ts, lag(total) OVER w AS was, {at('lag(ts) OVER w')} AS was_at FROM snap WINDOW w AS (PARTITION BY entity ORDER BY ts)""")
def _(t):
    return joins.asof_previous(t.snapshots, "entity", "ts", {"was": "total", "was_at": "ts"}).select("entity", "ts", "was", "was_at")


@check("d7_asof_join", """SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM
(SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
ON e.user_id = p.user_id AND e.ts >= p.ts""")
def _(t):
    e = t.events
    buys = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return joins.asof_join(e.filter("event_type = 'error'"), buys, "user_id", "ts", ["purchase_id", "purchase_value"]).select(
        "event_id", "purchase_id", "purchase_value")


@check("f1_lag", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_type FROM events")
def _(t):
    return chunked.with_previous(t.events, "user_id", ["ts", "event_id"], {"previous_id": "event_id", "previous_type": "event_type"}).select(
        "event_id", "previous_id", "previous_type")


@check("f2_lag_lead_default", """SELECT event_id, lag(event_id, 1, 0) OVER w AS previous_id, lead(event_id, 1, 2147483647) OVER w AS next_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _(t):
    e, by = t.events, chunked.by_range("event_id")
    out = chunked.with_previous(e, "user_id", "event_id", {"p": "event_id"}, by)
    out = chunked.with_next(out, "user_id", "event_id", {"n": "event_id"}, by)
    return out.select("event_id", F.coalesce("p", F.lit(0)).alias("previous_id"), F.coalesce("n", F.lit(2147483647)).alias("next_id"))


@check("f3_newest_per_group", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return chunked.newest_per_group(t.events.drop("props"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@check("f3_global_row_number", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS row_no FROM events")
def _(t):
    return chunked.number_rows(t.events.select("event_id", "ts"), [F.col("ts").desc(), "event_id"]).select("event_id", "row_no")


@check("f4_dense_rank", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) AS type_rank FROM events")
def _(t):
    return aggregate.dense_rank_of_few(t.events, "event_type", "type_rank").select("event_id", "type_rank")


@check("f4_dense_rank_many", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_totalprice) AS price_rank FROM orders")
def _(t):
    return aggregate.dense_rank_of_many(t.orders, "o_totalprice", "price_rank").select("o_orderkey", "price_rank")


@check("l10_distinct_state", """SELECT event_type AS of, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events FROM events GROUP BY event_type
UNION ALL SELECT strftime(ts, '%Y-%m'), count(DISTINCT user_id), count(DISTINCT event_id) FROM events GROUP BY 1""")
def _(t):
    rows = t.events.withColumn("day", F.to_date("ts"))
    states = {n: aggregate.distinct_state(rows, col, ["event_type", "day"]) for n, col in (("users", "user_id"), ("events", "event_id"))}
    of = {"event_type": F.col("event_type"), "month": F.date_format("day", "yyyy-MM")}
    by = lambda dim: [aggregate.distinct_from_state(s.withColumn("of", of[dim]), n, "of") for n, s in states.items()]
    first, second = (by(dim)[0].join(by(dim)[1], "of") for dim in of)
    return first.unionByName(second)


@check("f5_sum_over", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS orders_of_customer FROM orders")
def _(t):
    return chunked.with_group(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", {"orders_of_customer": F.count(F.lit(1))})


@check("f6_duration_anomaly", """WITH r AS (SELECT user_id, event_id, CAST(round(value * 1000) AS BIGINT) AS ms FROM events),
m AS (SELECT *, avg(ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean FROM r)
SELECT event_id, mean AS previous_mean_ms, CAST(CASE WHEN ms > mean * 3 AND ms > 60000 THEN 1 ELSE 0 END AS BIGINT) AS is_slow FROM m""")
def _(t):
    r = t.events.select("user_id", "event_id", F.round(F.col("value") * 1000).cast("bigint").alias("ms"))
    out = aggregate.duration_anomaly(r, "user_id", "event_id", "ms", 10, 3, 60_000, chunked.by_range("event_id", 2000), block=25)
    return out.select("event_id", "previous_mean_ms", "is_slow")


@check("f7_minutes_since_previous", "SELECT event_id, date_diff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS minutes_since_previous FROM events")
def _(t):
    return aggregate.minutes_since_previous(t.events, "user_id", "ts").select("event_id", "minutes_since_previous")
