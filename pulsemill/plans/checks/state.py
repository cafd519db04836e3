"""Stateful maintenance: H."""

from pyspark.sql import functions as F

from ...operators import state
from ...operators.aggregate import hourly_rollup
from ...operators.chunked import by_year
from ...session import scratch_dir
from ...sources import snapshots
from . import HISTORY, ORDER_STATES, STATE, at, check, day

_SPLIT = "TIMESTAMP '1999-06-30'"


@check("h1_scd2_merge", f"""WITH {STATE},
old AS (SELECT entity, key, value, valid_from, valid_to FROM state WHERE valid_from < {_SPLIT}),
st AS (SELECT entity, key, value, valid_from, CASE WHEN valid_to >= {_SPLIT} THEN TIMESTAMP '9999-12-31 23:59:59' ELSE valid_to END AS valid_to FROM old),
inv AS (SELECT entity, key, value FROM daily WHERE entity % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY ts DESC) = 1),
op AS (SELECT * FROM st WHERE valid_to = TIMESTAMP '9999-12-31 23:59:59'),
res AS (SELECT * FROM st WHERE valid_to <> TIMESTAMP '9999-12-31 23:59:59'
  UNION ALL SELECT op.entity, op.key, op.value, op.valid_from, CASE WHEN inv.value = op.value THEN op.valid_to ELSE TIMESTAMP '2001-09-01' END
    FROM op LEFT JOIN inv ON inv.entity = op.entity AND inv.key = op.key
  UNION ALL SELECT inv.entity, inv.key, inv.value, TIMESTAMP '2001-09-01', TIMESTAMP '9999-12-31 23:59:59' FROM inv
    WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.entity = inv.entity AND op.key = inv.key AND op.value = inv.value))
SELECT entity, key, value, {at('valid_from')} AS valid_from, {at('valid_to')} AS valid_to FROM res""")
def _(t):
    split, end = F.lit("1999-06-30").cast("timestamp"), F.lit("9999-12-31 23:59:59").cast("timestamp")
    old = t.state.filter(F.col("valid_from") < split).withColumn("valid_to", F.when(F.col("valid_to") >= split, end).otherwise(F.col("valid_to")))
    inventory = state.newest_per_group(t.order_states.filter("entity % 7 <> 0"), ["entity", "key"], ["ts", "seq"]).select("entity", "key", "value")
    return state.scd2_merge(old, inventory, ["entity", "key"], "value", F.lit("2001-09-01").cast("timestamp"))


@check("h2_scd2_build", f"""WITH {ORDER_STATES},
seen AS (SELECT *, lag(value) OVER (PARTITION BY entity, key ORDER BY ts, seq) AS was FROM obs),
ch AS (SELECT *, lead(ts) OVER (PARTITION BY entity, key ORDER BY ts, seq) AS nxt FROM seen WHERE was IS NULL OR was <> value)
SELECT entity, key, value, {at('ts')} AS valid_from, {at("coalesce(nxt, TIMESTAMP '9999-12-31 23:59:59')")} AS valid_to FROM ch""")
def _(t):
    return state.scd2_build(t.order_states, ["entity", "key"], "ts", "value", ["seq"], chunk=by_year("ts"))


@check("h3_state_history", f"""WITH {STATE},
st AS (SELECT entity, key, value, valid_from, CASE WHEN entity % 9 = 0 AND valid_to > TIMESTAMP '2002-01-01' THEN TIMESTAMP '2002-01-01' ELSE valid_to END AS valid_to FROM state),
h AS (SELECT *, lag(value) OVER (PARTITION BY entity, key ORDER BY valid_to DESC) AS newer_value FROM st
  WHERE entity IN (SELECT entity FROM st WHERE valid_to = TIMESTAMP '9999-12-31 23:59:59') AND key IN ('status', 'priority'))
SELECT entity, key, value, newer_value, {at('valid_from')} AS valid_from, {at("nullif(valid_to, TIMESTAMP '9999-12-31 23:59:59')")} AS valid_to
FROM h WHERE (value <> '' AND value <> newer_value) OR newer_value IS NULL""")
def _(t):
    gone = (F.col("entity") % 9 == 0) & (F.col("valid_to") > F.lit("2002-01-01").cast("timestamp"))
    st = t.state.withColumn("valid_to", F.when(gone, F.lit("2002-01-01").cast("timestamp")).otherwise(F.col("valid_to")))
    return state.state_history(st, "entity", only_keys=["status", "priority"], ignore_empty=True)


@check("h4_state_as_of", f"WITH {STATE} SELECT entity, key, value FROM state WHERE valid_from <= {_SPLIT} AND valid_to > {_SPLIT}")
def _(t):
    return state.state_as_of(t.state, F.lit("1999-06-30").cast("timestamp")).select("entity", "key", "value")


@check("h5_rollup_merge", f"""WITH {HISTORY} SELECT job, CAST(status AS BIGINT) AS status, {day('started')} AS date, hour(started) AS hour, count(*) AS cnt,
CAST(sum(duration_s) AS BIGINT) AS sum_s, min(duration_s) AS min_s, max(duration_s) AS max_s FROM hist GROUP BY 1, 2, 3, 4""")
def _(t):
    h = t.history
    first, rest = (hourly_rollup(h.filter(c), ["job", "status"], "started", "duration_s") for c in ("seq % 3 = 0", "seq % 3 <> 0"))
    return state.rollup_merge(first, rest, ["job", "status", "date", "hour"])


@check("h6_advance_watermark", f"SELECT user_id, {at('max(ts)')} AS ts FROM events GROUP BY 1")
def _(t):
    e = t.events
    split = F.lit("2024-01-10").cast("timestamp")
    return state.advance_watermark(e.filter(F.col("ts") < split), e.filter(F.col("ts") >= split), "user_id", "ts")


_DICT = """t AS (SELECT p_brand AS brand, max(p_name) AS text, count(*) AS n FROM part WHERE p_size <= 25 AND p_brand <> 'Brand#3' GROUP BY 1),
s AS (SELECT p_brand AS brand, max(p_name) AS text, count(*) AS n FROM part WHERE p_size > 25 AND p_brand <> 'Brand#5' GROUP BY 1)"""


def _dicts(t):
    by = lambda c: t.part.filter(c).groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_name").alias("text"), F.count(F.lit(1)).alias("n"))
    return by("p_size <= 25 AND p_brand <> 'Brand#3'"), by("p_size > 25 AND p_brand <> 'Brand#5'")


@check("h7_upsert_always", f"WITH {_DICT} SELECT coalesce(s.brand, t.brand) AS brand, CASE WHEN s.brand IS NULL THEN t.text ELSE s.text END AS text, CASE WHEN s.brand IS NULL THEN t.n ELSE s.n END AS n FROM t FULL JOIN s ON s.brand = t.brand")
def _(t):
    return state.upsert(*_dicts(t), "brand")


@check("h7_upsert_insert_only", f"WITH {_DICT} SELECT * FROM t UNION ALL SELECT * FROM s WHERE brand NOT IN (SELECT brand FROM t)")
def _(t):
    return state.upsert(*_dicts(t), "brand", mode="insert_only")


@check("h7_upsert_if_different", f"""WITH {_DICT} SELECT coalesce(t.brand, s.brand) AS brand, CASE WHEN t.brand IS NULL OR s.text <> t.text THEN s.text ELSE t.text END AS text,
CASE WHEN t.brand IS NULL THEN s.n ELSE t.n END AS n FROM t FULL JOIN s ON s.brand = t.brand""")
def _(t):
    return state.upsert(*_dicts(t), "brand", ["text"], "if_different")


@check("h8_upsert_keep_previous", f"""WITH {_DICT} SELECT coalesce(t.brand, s.brand) AS brand, CASE WHEN t.brand IS NULL OR s.text <> t.text THEN s.text ELSE t.text END AS text,
CASE WHEN s.text <> t.text THEN t.text END AS previous_value, CAST(CASE WHEN s.text <> t.text THEN 1 ELSE 0 END AS BIGINT) AS changes FROM t FULL JOIN s ON s.brand = t.brand""")
def _(t):
    target, source = _dicts(t)
    target = target.select("brand", "text", F.lit(None).cast("string").alias("previous_value"), F.lit(0).cast("bigint").alias("changes"))
    return state.upsert_keep_previous(target, source, "brand", "text")


@check("h9_delete_orphans", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    facts = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return state.delete_orphans(t.part, facts, "p_partkey").select("p_partkey")


@check("h10_apply_retention", """WITH m AS (SELECT max(l_shipdate) AS m FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag FROM lineitem, m
WHERE l_shipdate >= m - INTERVAL 900 DAY AND NOT (l_returnflag = 'R' AND l_shipdate < m - INTERVAL 200 DAY)""")
def _(t):
    return state.apply_retention(t.lineitem, "l_shipdate", [(900, None), (200, F.col("l_returnflag") == "R")]).select(
        "l_orderkey", "l_linenumber", "l_returnflag")


@check("h10_retain_days", f"""WITH m AS (SELECT max(ts) AS m FROM events)
SELECT {day('ts')} AS date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events, m
WHERE ts >= m - INTERVAL 20 DAY AND NOT (event_type = 'view' AND ts < m - INTERVAL 5 DAY) GROUP BY 1""")
def _(t):
    """The same on day folders: whole days go unread, days with such views are written again; a second run changes nothing."""
    path, rules = scratch_dir(t.spark, "retain"), [(20, None), (5, F.col("event_type") == "view")]
    snapshots.append_snapshot(t.events.select("event_id", "event_type", "ts"), path, "ts", spread=True)
    for _ in range(2):
        snapshots.retain_days(t.spark, path, "ts", rules)
    return t.spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@check("h11_keep_newest", "SELECT job, seq, CAST(status AS BIGINT) AS status FROM (WITH " + HISTORY + " SELECT * FROM hist) QUALIFY row_number() OVER (PARTITION BY job ORDER BY started DESC) = 1")
def _(t):
    return state.keep_newest(t.history, "job", "started").select("job", "seq", "status")


@check("h12_pair_begin_end", f"""WITH r AS (SELECT user_id, CAST(event_id // 500 AS BIGINT) AS run, min(CASE WHEN event_type = 'click' THEN ts END) AS started,
max(CASE WHEN event_type = 'purchase' THEN ts END) AS ended FROM events GROUP BY 1, 2)
SELECT user_id, run, {at('started')} AS started, {at('ended')} AS ended, date_diff('millisecond', started, ended) AS duration_ms FROM r WHERE started IS NOT NULL""")
def _(t):
    log = t.events.withColumn("run", F.floor(F.col("event_id") / 500))
    return state.pair_begin_end(log, ["user_id", "run"], "ts", F.col("event_type") == "click", F.col("event_type") == "purchase")


@check("h13_missing_run_markers", f"""WITH latest AS (SELECT user_id AS name, max(ts) AS started FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
delta AS (SELECT user_id AS name, ts AS started FROM events WHERE user_id % 3 = 0),
marked AS (SELECT user_id AS name, CAST(ts AS DATE) AS date, hour(ts) AS hour FROM events WHERE user_id % 3 = 1 AND event_type = 'error')
SELECT name, {at('started')} AS started, CAST(-1 AS BIGINT) AS job_status, CAST(-1 AS BIGINT) AS steps_status, CAST(0 AS BIGINT) AS duration_s FROM latest l
WHERE NOT EXISTS (SELECT 1 FROM delta d WHERE d.name = l.name AND d.started = l.started)
AND NOT EXISTS (SELECT 1 FROM marked m WHERE m.name = l.name AND m.date = CAST(l.started AS DATE) AND m.hour = hour(l.started))""")
def _(t):
    runs = t.events.select(F.col("user_id").alias("name"), F.col("ts").alias("started"), "event_type")
    marked = runs.filter("name % 3 = 1 AND event_type = 'error'").select(
        "name", F.lit(-1).alias("job_status"), F.lit(-1).alias("steps_status"), F.to_date("started").alias("date"), F.hour("started").alias("hour"))
    return state.missing_run_markers(runs.filter(F.col("started") < F.lit("2024-01-15").cast("timestamp")), runs.filter("name % 3 = 0"), marked)
