"""Report presets over canonical tables that Spark derives from the given ones."""

from pyspark.sql import Column, DataFrame, functions as F

from ...operators.aggregate import hourly_rollup
from ...operators.runs import runs_from_history
from .. import views
from . import SCHEDULES, SNAPSHOTS, STATE, at, check, day
from .columns import SCHEDULE_TEXT, key_sql
from .runs import _GRID, _RUNS, _SLOT_TEST, xml_events

NOW = "2024-02-01 12:00:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _text(prefix: str, col) -> Column:
    return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))


def _show(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*columns.replace("\n", " ").replace(" ", "").split(","))


_LAGS = """p AS (SELECT *, lag(total) OVER w AS p_total, lag(hits) OVER w AS p_hits, lag(epoch) OVER w AS p_epoch, lag(ts) OVER w AS p_ts,
 lag(sample_ms) OVER w AS p_ms FROM snap WINDOW w AS (PARTITION BY entity ORDER BY ts))"""


def _gain(c: str, reset: str, null: str = "false") -> str:
    return f"CASE WHEN {null} OR p_{c} IS NULL THEN NULL WHEN {reset} OR p_{c} > {c} THEN {c} ELSE {c} - p_{c} END"


_TK = "hour({0}) * 3600 + minute({0}) * 60 + second({0})"


@check("view_wait_statistics", f"""WITH {SNAPSHOTS}, {_LAGS},
d AS (SELECT 'w' || entity AS wait_type, ts + INTERVAL 1 HOUR AS ts, {_gain('total', 'p_epoch <> epoch', "date_diff('hour', p_ts, ts) > 12")} AS a,
 {_gain('hits', 'p_epoch <> epoch', "date_diff('hour', p_ts, ts) > 12")} AS b FROM p)
SELECT wait_type, {at('ts')} AS ts, a AS delta_sum_wait_ms, b AS delta_tasks, {day('ts')} AS date, {_TK.format('ts')} AS time_key, {key_sql('upper(wait_type)')} AS wait_key
FROM d WHERE a <> 0 OR b <> 0""")
def _(t):
    waits = t.snapshots.select(_text("w", "entity").alias("wait_type"), F.col("total").alias("sum_wait_ms"), (F.col("hits") * 2).alias("sum_signal_ms"),
                               F.col("hits").alias("tasks"), F.col("epoch").alias("restart_ts"), F.col("ts").alias("ts_utc"),
                               F.timestamp_add("HOUR", F.lit(1), "ts").alias("ts"))
    return _show(views.build("wait_statistics", {"wait_counters": waits}, _now()), "wait_type, ts, delta_sum_wait_ms, delta_tasks, date, time_key, wait_key")


@check("view_database_io", f"""WITH {SNAPSHOTS}, {_LAGS},
d AS (SELECT entity, ts, {_gain('total', 'p_ms > sample_ms')} AS a, {_gain('hits', 'p_ms > sample_ms')} AS b FROM p)
SELECT 'd' || entity % 4 AS database, 'f' || entity AS file, CASE WHEN entity % 2 = 0 THEN 'Data' ELSE 'Log' END AS type_text, {at('ts')} AS ts, b AS delta_reads, a AS delta_stall_read_ms,
a / nullif(CAST(b AS DOUBLE), 0) AS read_latency_ms FROM d WHERE a <> 0 OR b <> 0""")
def _(t):
    same = {n: F.col("total") for n in ("bytes_read", "stall_read_ms", "bytes_written", "stall_write_ms")}
    io = t.snapshots.withColumns({**same, "reads": F.col("hits"), "writes": F.col("hits"), "ts_utc": F.col("ts"), "type": F.col("entity") % 2,
                                  "database": _text("d", F.col("entity") % 4), "file": _text("f", "entity")})
    return _show(views.build("database_io", {"file_io": io}, _now()), "database, file, type_text, ts, delta_reads, delta_stall_read_ms, read_latency_ms")


@check("view_cpu_per_database", f"""WITH {SNAPSHOTS}, {_LAGS}, d AS (SELECT entity, ts, {_gain('total', 'false')} AS a FROM p)
SELECT 'd' || entity AS database, {at('ts')} AS ts, a AS delta_cpu_ms, CAST(a AS DOUBLE) / nullif(CAST(sum(a) OVER (PARTITION BY ts) AS DOUBLE), 0) AS cpu_share FROM d""")
def _(t):
    cpu = t.snapshots.select(_text("d", "entity").alias("database"), F.col("total").alias("cpu_ms"), F.col("ts").alias("ts_utc"), "ts")
    return _show(views.build("cpu_per_database", {"cpu_per_database": cpu}, _now()), "database, ts, delta_cpu_ms, cpu_share")


_BACKUPS = """b AS (SELECT 'd' || user_id % 30 AS database, CASE event_type WHEN 'click' THEN 'D' WHEN 'view' THEN 'I' WHEN 'purchase' THEN 'L' WHEN 'error' THEN 'X' END AS type,
 ts AS start, ts + INTERVAL (CAST(floor(value) AS BIGINT)) SECOND AS finish, event_id % 10 = 0 AS copy_only, event_id % 17 = 0 AS damaged FROM events)"""


def _backups(t) -> DataFrame:
    kind = F.create_map(*[F.lit(v) for kv in {"click": "D", "view": "I", "purchase": "L", "error": "X"}.items() for v in kv])
    striped = F.explode(F.array(F.lit("file1"), F.lit("file2")))
    return t.events.select(
        _text("d", F.col("user_id") % 30).alias("database"), F.try_element_at(kind, F.col("event_type")).alias("type"), F.col("ts").alias("start"),
        F.timestamp_add("SECOND", F.floor("value").cast("int"), "ts").alias("finish"), F.col("event_id").alias("size"), F.col("event_id").alias("compressed"),
        (F.col("event_id") % 10 == 0).alias("copy_only"), (F.col("event_id") % 17 == 0).alias("damaged"), striped.alias("device"), F.col("ts").alias("ts_utc"), "ts")


@check("view_backup_status", f"""WITH {_BACKUPS} SELECT database, {at('start')} AS start, CASE type WHEN 'D' THEN 'Database' WHEN 'I' THEN 'Differential database' WHEN 'L' THEN 'Log' ELSE '?:' || coalesce(type, '<NULL>') END AS type_text,
coalesce(nullif(date_diff('second', start, finish), 0), 1) AS duration_s, CAST(2 AS BIGINT) AS files, CASE WHEN copy_only THEN 'Yes' ELSE 'No' END AS copy_only_text, CASE WHEN damaged THEN 'Yes' ELSE 'No' END AS damaged_text FROM b""")
def _(t):
    return _show(views.build("backup_status", {"backups": _backups(t)}, _now()), "database, start, type_text, duration_s, files, copy_only_text, damaged_text")


def _database_state(t, keys) -> DataFrame:
    """Customers as databases; their order status and priority as two settings."""
    value = F.when(F.col("key") == "status", F.when(F.col("value") == "O", "1").when(F.col("value") == "F", "3").otherwise("9")).otherwise(F.left("value", F.lit(1)))
    mapped = F.create_map(*[F.lit(v) for kv in keys.items() for v in kv])
    return t.state.select(F.lit(31).alias("query"), _text("d", "entity").alias("database"), mapped[F.col("key")].alias("key"), value.alias("value"),
                          "valid_from", "valid_to", F.col("valid_from").alias("ts_utc"), F.col("valid_from").alias("ts"))


_DB_STATE = STATE + """,
ds AS (SELECT 'd' || entity AS database, CASE key WHEN 'status' THEN 'recovery_model' ELSE 'state' END AS key,
 CASE WHEN key = 'status' THEN CASE value WHEN 'O' THEN '1' WHEN 'F' THEN '3' ELSE '9' END ELSE left(value, 1) END AS value, valid_from, valid_to FROM state)"""
_SETTINGS = {"status": "recovery_model", "priority": "state"}
_MODEL = "CASE {0} WHEN '1' THEN 'Full' WHEN '3' THEN 'Simple' WHEN '9' THEN '?:9' END"
_DBSTATE = "CASE {0} WHEN '1' THEN 'Restoring' WHEN '2' THEN 'Recovering' WHEN '3' THEN 'Recovery pending' WHEN '4' THEN 'Suspect' WHEN '5' THEN 'Emergency' END"


@check("view_backup_age", f"""WITH {_BACKUPS}, {_DB_STATE},
m AS (SELECT database, {_MODEL.format('value')} AS recovery_model, valid_from AS since FROM ds WHERE key = 'recovery_model' AND valid_to = TIMESTAMP '9999-12-31 23:59:59'),
l AS (SELECT database, max(CASE WHEN type = 'D' THEN start END) AS f, max(CASE WHEN type = 'I' THEN start END) AS i, max(CASE WHEN type = 'L' THEN start END) AS l FROM b WHERE NOT copy_only AND NOT damaged GROUP BY 1),
j AS (SELECT m.*, CASE WHEN f > since THEN f ELSE TIMESTAMP '1900-01-01' END AS f, CASE WHEN i > since THEN i WHEN i IS NOT NULL THEN TIMESTAMP '1900-01-01' END AS i,
 CASE WHEN recovery_model = 'Full' THEN CASE WHEN l > since THEN l ELSE TIMESTAMP '1900-01-01' END END AS l FROM m LEFT JOIN l USING (database))
SELECT database, recovery_model, {at("nullif(f, TIMESTAMP '1900-01-01')")} AS latest_full, {at("nullif(i, TIMESTAMP '1900-01-01')")} AS latest_diff, {at("nullif(l, TIMESTAMP '1900-01-01')")} AS latest_log,
date_diff('minute', f, TIMESTAMP '{NOW}') // 60 AS full_age_hours, date_diff('minute', i, TIMESTAMP '{NOW}') // 60 AS diff_age_hours, date_diff('minute', l, TIMESTAMP '{NOW}') // 60 AS log_age_hours FROM j""")
def _(t):
    tables = {"database_state": _database_state(t, _SETTINGS), "backups": _backups(t)}
    return _show(views.build("backup_age", tables, _now()), "database, recovery_model, latest_full, latest_diff, latest_log, full_age_hours, diff_age_hours, log_age_hours")


@check("view_database_state", f"""WITH {_DB_STATE}, o AS (SELECT * FROM ds WHERE valid_to = TIMESTAMP '9999-12-31 23:59:59'),
w AS (SELECT database, max(CASE WHEN key = 'recovery_model' THEN value END) AS r, max(CASE WHEN key = 'state' THEN value END) AS s, min(valid_from) AS lo, max(valid_from) AS hi FROM o GROUP BY 1)
SELECT database, {_MODEL.format('r')} AS recovery_model, {_DBSTATE.format('s')} AS state, 'N.A.' AS is_read_only_text, {at('lo')} AS min_ts, {at('hi')} AS max_ts, {key_sql('upper(database)')} AS database_key FROM w""")
def _(t):
    return _show(views.build("database_state", {"database_state": _database_state(t, _SETTINGS)}, _now()), "database, recovery_model, state, is_read_only_text, min_ts, max_ts, database_key")


@check("view_database_state_history", f"""WITH {_DB_STATE}, h AS (SELECT *, lag(value) OVER (PARTITION BY database, key ORDER BY valid_to DESC) AS newer_value FROM ds)
SELECT database, key, newer_value, CASE key WHEN 'recovery_model' THEN {_MODEL.format('value')} ELSE {_DBSTATE.format('value')} END AS value_text, {at('valid_from')} AS valid_from,
{at("nullif(valid_to, TIMESTAMP '9999-12-31 23:59:59')")} AS valid_to FROM h WHERE value <> newer_value OR newer_value IS NULL""")
def _(t):
    return _show(views.build("database_state_history", {"database_state": _database_state(t, _SETTINGS)}, _now()), "database, key, newer_value, value_text, valid_from, valid_to")


def _index_usage(t) -> DataFrame:
    used = F.when(F.col("entity") % 3 > 0, F.col("total")).otherwise(F.lit(0))
    return t.snapshots.select(F.lit("d").alias("database"), F.lit("s").alias("schema"), _text("o", F.col("entity") % 5).alias("object"),
                              F.when(F.col("entity") != 4, _text("i", "entity")).alias("index"), used.alias("seeks"), *[F.lit(0).cast("bigint").alias(n) for n in ("scans", "lookups", "updates")],
                              F.col("epoch").alias("restart_ts"), F.col("ts").alias("ts_utc"), "ts")


_INDEX_DELTAS = f"""{SNAPSHOTS},
u AS (SELECT entity, 'o' || entity % 5 AS object, CASE WHEN entity <> 4 THEN 'i' || entity END AS index, CASE WHEN entity % 3 > 0 THEN total ELSE 0 END AS seeks, epoch, ts FROM snap),
stamps AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev FROM (SELECT DISTINCT ts FROM u)),
d AS (SELECT a.object, a.index, a.ts, CASE WHEN b.seeks > a.seeks OR b.epoch <> a.epoch THEN a.seeks ELSE a.seeks - b.seeks END AS delta_seeks
 FROM u a JOIN stamps USING (ts) JOIN u b ON b.entity = a.entity AND b.ts = prev)"""


@check("view_index_usage", f"WITH {_INDEX_DELTAS} SELECT object, index, {at('ts')} AS ts, delta_seeks, {key_sql(chr(39) + 'D' + chr(39) + ' || chr(31) || ' + chr(39) + 'S' + chr(39) + ' || chr(31) || upper(object) || chr(31) || upper(coalesce(index, ' + chr(39) + 'N.A.' + chr(39) + '))')} AS index_key FROM d WHERE delta_seeks <> 0")
def _(t):
    return _show(views.build("index_usage", {"index_usage": _index_usage(t)}, _now()), "object, index, ts, delta_seeks, index_key")


@check("view_index_not_used", f"WITH {_INDEX_DELTAS} SELECT object, index FROM u WHERE ts = (SELECT max(ts) FROM u) AND index IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.object = u.object AND d.index = u.index AND delta_seeks <> 0)")
def _(t):
    return _show(views.build("index_not_used", {"index_usage": _index_usage(t)}, _now()), "object, index")


@check("view_missing_indexes", f"""WITH {SNAPSHOTS}, {_LAGS}, d AS (SELECT entity, ts, {_gain('total', 'p_epoch <> epoch')} AS a, {_gain('hits', 'p_epoch <> epoch')} AS b FROM p WHERE entity <> 0)
SELECT 'o' || entity AS object, CASE WHEN entity % 2 = 0 THEN 'c1' END AS inequality, {at('ts')} AS ts, a AS delta_seeks, b AS delta_scans FROM d WHERE a <> 0 OR b <> 0""")
def _(t):
    found, null = F.col("entity") != 0, F.lit(None).cast("string")
    rows = t.snapshots.select(F.when(found, "d").otherwise("").alias("database"), F.when(found, "s").otherwise("").alias("schema"), F.when(found, _text("o", "entity")).otherwise("").alias("object"),
                              F.lit("q").alias("query_hash"), null.alias("equality"), F.when(F.col("entity") % 2 == 0, "c1").alias("inequality"), null.alias("included"),
                              F.col("total").alias("seeks"), F.col("hits").alias("scans"), F.col("epoch").alias("restart_ts"), F.col("ts").alias("ts_utc"), "ts")
    return _show(views.build("missing_indexes", {"missing_indexes": rows}, _now()), "object, inequality, ts, delta_seeks, delta_scans")


@check("view_who_is_active", f"""WITH s AS (SELECT user_id AS session, date_trunc('day', ts) AS login_ts, ts AS collected, event_type AS sql_text, CAST(round(value * 100) AS BIGINT) AS cpu, event_id AS reads FROM events),
f AS (SELECT *, first_value(cpu) OVER w AS first_cpu, reads - first_value(reads) OVER w AS delta_reads FROM s WINDOW w AS (PARTITION BY session, login_ts ORDER BY collected)),
n AS (SELECT * FROM f WHERE sql_text <> 'sp_server_diagnostics' AND date_diff('hour', collected, (SELECT max(collected) FROM s)) < 24
 QUALIFY row_number() OVER (PARTITION BY session, login_ts ORDER BY collected DESC) = 1)
SELECT session, {at('collected')} AS collected, sql_text, cpu - first_cpu AS delta_cpu, date_diff('second', collected, (SELECT max(ts) FROM events WHERE event_type = 'view')) AS seconds_since_last_seen,
date_diff('millisecond', login_ts, collected) AS elapsed_ms, row_number() OVER (ORDER BY n.collected, delta_reads, session DESC) AS sort_order FROM n ORDER BY n.collected DESC, session LIMIT 1000""")
def _(t):
    s = t.events.select(F.col("user_id").alias("session"), F.date_trunc("day", "ts").alias("login_ts"), F.date_trunc("day", "ts").alias("start_ts"), F.col("ts").alias("collected"),
                        F.round(F.col("value") * 100).cast("bigint").alias("cpu"), F.col("event_id").alias("reads"), F.col("event_id").alias("writes"), F.col("event_type").alias("sql_text"))
    log = _log(t).withColumn("name", F.when(F.col("text") == "view", "Who is active"))
    return _show(views.build("who_is_active", {"session_samples": s, "log": log}, _now()),
                 "session, collected, sql_text, delta_cpu, seconds_since_last_seen, elapsed_ms, sort_order")


@check("view_agent_jobs_performance", f"""WITH {_RUNS},
x AS (SELECT job, status, coalesce((SELECT min(h.status) FROM hist h WHERE h.job = r.job AND h.status <> 1 AND h.seq > r.prev_seq AND h.seq <= r.seq), 1) AS steps_status, started,
 CASE WHEN duration_s = 0 THEN 1 ELSE duration_s END AS d FROM r WHERE EXISTS (SELECT 1 FROM hist h WHERE h.job = r.job AND h.step <> 0 AND h.seq > r.prev_seq AND h.seq < r.next_seq))
SELECT CAST(job AS VARCHAR) AS name, {day('started')} AS date, hour(started) * 3600 AS time_key, CAST(CASE WHEN status = 1 AND steps_status = 0 THEN 1 WHEN status = 1 THEN 0 WHEN status = 0 THEN 2 WHEN status = 3 THEN 4 END AS BIGINT) AS outcome_key,
count(*) AS cnt, CAST(sum(d) AS BIGINT) AS sum_s, min(d) AS min_s, max(d) AS max_s FROM x GROUP BY job, status, steps_status, 2, 3""")
def _(t):
    done = runs_from_history(t.history, "job", "seq", "step", "status", "started", "duration_s")
    rollup = hourly_rollup(done.withColumn("name", F.col("job").cast("string")), ["name", "job_status", "steps_status"], "started", "duration_s")
    return _show(views.build("agent_jobs_performance", {"hourly_rollup": rollup}, _now()), "name, date, time_key, outcome_key, cnt, sum_s, min_s, max_s")


@check("view_agent_jobs_grid", f"""WITH {SCHEDULES}, txt AS (SELECT *, {SCHEDULE_TEXT} FROM sched)
SELECT job, schedule_id, when_text, {_GRID} FROM txt, range(24) AS r(n) WHERE freq_type IN (4, 8) AND end_date >= DATE '2024-02-01' AND ({_SLOT_TEST}) GROUP BY 1, 2, 3""")
def _(t):
    polled = t.schedules.withColumn("ts_utc", _now())
    older = polled.withColumn("ts_utc", F.timestamp_add("DAY", F.lit(-1), "ts_utc"))
    grid = views.build("agent_jobs_grid", {"job_schedules": polled.unionByName(older)}, _now())
    return grid.select("job", "schedule_id", "when_text", *[f"h{h:02d}" for h in range(24)])


@check("view_partitioned_indexes", f"""WITH b AS (SELECT DISTINCT p_brand, p_size, length(p_brand) = 7 AS on_right FROM part),
n AS (SELECT *, row_number() OVER w AS partition, lag(p_size) OVER w AS lo, lead(p_size) OVER w AS hi FROM b WINDOW w AS (PARTITION BY p_brand ORDER BY p_size))
SELECT p_brand AS object, partition, CASE WHEN on_right THEN 'size >= ' || p_size || ' and size < ' || coalesce(CAST(hi AS VARCHAR), 'Infinity') ELSE 'size > ' || coalesce(CAST(lo AS VARCHAR), 'Infinity') || ' and size <= ' || p_size END AS partition_range,
row_number() OVER (ORDER BY ts DESC, p_brand, CASE WHEN on_right THEN 2 ELSE 1 END, printf('%02d', p_size)) AS sort_order, {day('ts')} AS date FROM n, (VALUES (TIMESTAMP '{NOW}'), (TIMESTAMP '{NOW}' - INTERVAL 1 DAY)) AS v(ts)""")
def _(t):
    from ...operators.chunked import by_range, with_row_number
    sizes = t.part.select("p_brand", "p_size").distinct()
    sizes = with_row_number(sizes, "p_brand", "p_size", "partition", by_range("p_size", 1000))
    p = sizes.select(F.lit("d").alias("database"), F.lit("s").alias("schema"), F.col("p_brand").alias("object"), F.lit("i").alias("index"), F.lit("g").alias("filegroup"), "partition",
                     F.lit("size").alias("partition_column"), F.col("p_size").alias("boundary"), (F.length("p_brand") == 7).alias("boundary_on_right"),
                     F.explode(F.array(_now(), F.timestamp_add("DAY", F.lit(-1), _now()))).alias("ts")).withColumn("ts_utc", F.col("ts"))
    return _show(views.build("partitioned_indexes", {"partitioned_indexes": p}, _now()), "object, partition, partition_range, sort_order, date")


@check("view_vlf_size", f"""SELECT 'd' || user_id AS database, event_id AS vlf_count, {day('h')} AS date FROM (SELECT *, date_trunc('hour', ts) AS h FROM events)
QUALIFY rank() OVER (PARTITION BY CAST(h AS DATE) ORDER BY h DESC) = 1""")
def _(t):
    v = t.events.select(_text("d", "user_id").alias("database"), F.col("event_id").alias("vlf_count"), F.date_trunc("hour", "ts").alias("ts"))
    return _show(views.build("vlf_size", {"vlf_sizes": v}, _now()), "database, vlf_count, date")


_MODE = "CASE l_returnflag WHEN 'R' THEN 'DETAILED' WHEN 'A' THEN 'SAMPLED' ELSE 'LIMITED' END"


def _scans(t) -> DataFrame:
    mode = F.when(F.col("l_returnflag") == "R", "DETAILED").when(F.col("l_returnflag") == "A", "SAMPLED").otherwise("LIMITED")
    return t.lineitem.select(F.lit("d").alias("database"), F.lit("s").alias("schema"), _text("o", F.col("l_suppkey") % 10).alias("object"), _text("i", "l_suppkey").alias("index"), F.lit(1).alias("partition"),
                             mode.alias("mode"), F.col("l_quantity").alias("fragmentation"), F.col("l_orderkey").alias("pages"), F.col("l_shipdate").alias("ts_utc"), F.col("l_shipdate").alias("ts"))


# The mode is chosen for an object; its indexes were scanned in different modes.
_SCANNED = f"x AS (SELECT *, {_MODE} AS mode, l_suppkey % 10 AS object FROM lineitem)"


@check("view_index_physical", f"""WITH {_SCANNED}, near AS (SELECT * FROM x WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 24 HOUR)
SELECT 'i' || l_suppkey AS index, mode, l_orderkey AS pages, l_quantity AS fragmentation, {day('l_shipdate')} AS date FROM near
QUALIFY dense_rank() OVER (PARTITION BY object ORDER BY CASE mode WHEN 'DETAILED' THEN 1 WHEN 'SAMPLED' THEN 2 ELSE 3 END, l_shipdate DESC) = 1""")
def _(t):
    return _show(views.build("index_physical", {"index_physical": _scans(t)}, _now()), "index, mode, pages, fragmentation, date")


@check("view_index_physical_detailed", f"""WITH {_SCANNED},
has AS (SELECT object, CAST(l_shipdate AS DATE) AS d, bool_or(mode = 'DETAILED') AS detailed, bool_or(mode IN ('DETAILED', 'SAMPLED')) AS better FROM x GROUP BY 1, 2)
SELECT 'i' || l_suppkey AS index, mode, l_orderkey AS pages, {day('l_shipdate')} AS date FROM x JOIN has ON has.object = x.object AND has.d = CAST(x.l_shipdate AS DATE)
WHERE mode = 'DETAILED' OR (mode = 'SAMPLED' AND NOT detailed) OR NOT better""")
def _(t):
    return _show(views.build("index_physical_detailed", {"index_physical": _scans(t)}, _now()), "index, mode, pages, date")


@check("view_blocked_process", """WITH sets AS (SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id <> event_id % 150 AND date_diff('day', ts, (SELECT max(ts) FROM events)) < 7 ORDER BY ts DESC LIMIT 500)
SELECT event_id AS data_set, 'Blocked' AS type, user_id AS spid, event_type AS client_app FROM events WHERE event_id IN (SELECT event_id FROM sets)
UNION ALL SELECT event_id, 'Blocking', event_id % 150, 'batch' FROM events WHERE event_id IN (SELECT event_id FROM sets)""")
def _(t):
    return _show(views.build("blocked_process", {"xml_events": xml_events(t)}, _now()), "data_set, type, spid, client_app")


@check("view_log_shipping_monitor_primaries", f"""SELECT CASE WHEN user_id % 2 = 0 THEN 's0' ELSE 's1' END AS server, 'd' || user_id AS database, 'd' || user_id || ' - ' || CASE WHEN user_id % 2 = 0 THEN 's0' ELSE 's1' END AS database_server,
{at('ts')} AS last_ts, date_diff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS minutes_since_previous FROM events WHERE event_type = 'click'""")
def _(t):
    agent = F.when(F.col("event_type") == "click", "monitor backup").otherwise("copy")
    e = t.events.select(F.when(F.col("user_id") % 2 == 0, "s0").otherwise("s1").alias("server"), _text("d", "user_id").alias("database"), agent.alias("agent"),
                        F.col("ts").alias("last_ts_utc"), F.col("ts").alias("last_ts"))
    return _show(views.build("log_shipping_monitor_primaries", {"log_shipping_events": e}, _now()), "server, database, database_server, last_ts, minutes_since_previous")


@check("view_dimension_database", f"""WITH d AS (SELECT 'd' || user_id % 30 AS database FROM events UNION SELECT 'd' || o_custkey FROM orders) SELECT database, {key_sql('upper(database)')} AS database_key FROM d""")
def _(t):
    tables = {"backups": _backups(t), "other": t.orders.select(F.upper(_text("d", "o_custkey")).alias("database")).unionByName(t.orders.select(_text("d", "o_custkey").alias("database")))}
    dim = views.build("dimension_database", tables, _now())
    return dim.withColumn("database", F.lower("database"))


@check("view_query_statements", """SELECT '0x' || hex(p_brand) AS query_hash, CASE WHEN length(p_name) > 1000 THEN 'long' ELSE p_name END AS statement FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1""")
def _(t):
    s = t.part.select(F.lit("d").alias("database"), F.col("p_brand").cast("binary").alias("query_hash"), F.col("p_name").alias("statement"), F.col("p_partkey").alias("ts_utc"))
    return _show(views.build("query_statements", {"statements": s}, _now()), "query_hash, statement")


@check("view_blocked_process_all", """WITH sets AS (SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id <> event_id % 150)
SELECT event_id AS data_set, 'Blocked' AS type, user_id AS spid, event_type AS client_app FROM events WHERE event_id IN (SELECT event_id FROM sets)
UNION ALL SELECT event_id, 'Blocking', event_id % 150, 'batch' FROM events WHERE event_id IN (SELECT event_id FROM sets)""")
def _(t):
    """The report without its bounds."""
    bounds = {"blocked_process.days": 0, "blocked_process.sets": 0}
    return _show(views.build("blocked_process", {"xml_events": xml_events(t)}, _now(), bounds), "data_set, type, spid, client_app")


def _log(t) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.lit("n").alias("name"),
                           F.when(F.col("event_type") == "click", "Info").when(F.col("event_type") == "view", "Debug").otherwise("Error").alias("type"),
                           F.col("event_type").alias("text"), F.col("ts").alias("ts_utc"), "ts")


@check("view_log", """SELECT event_id AS id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY ORDER BY ts DESC, event_id LIMIT 10000""")
def _(t):
    return _show(views.build("log", {"log": _log(t)}, _now()), "id")


@check("view_log_non_debug_info", """SELECT event_id AS id FROM events WHERE event_type NOT IN ('click', 'view')
AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY ts DESC, event_id LIMIT 1000""")
def _(t):
    return _show(views.build("log_non_debug_info", {"log": _log(t)}, _now()), "id")


def _instance(t, query: int, rows) -> DataFrame:
    """State rows of one query: (category, {key: value}) from the table part."""
    keys = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in rows.items()])
    return t.part.select(F.lit(query).alias("query"), F.col("p_partkey").cast("string").alias("category"), F.inline(keys),
                         _ts("2024-01-01").alias("valid_from"), _ts("9999-12-31 23:59:59").alias("valid_to"),
                         _ts("2024-01-01").alias("ts_utc"), _ts("2024-01-01").alias("ts"))


def _ts(text: str):
    return F.lit(text).cast("timestamp")


@check("view_agent_alerts", """WITH wanted AS (SELECT DISTINCT p_size AS message_id, CAST(p_partkey % 5 AS INTEGER) AS severity FROM part),
found AS (SELECT p_partkey, p_size, CAST(p_partkey % 7 AS INTEGER) AS severity FROM part WHERE p_partkey % 3 = 0)
SELECT CAST(w.message_id AS BIGINT) AS message_id, CAST(w.severity AS BIGINT) AS severity, CAST(f.p_partkey AS VARCHAR) AS alert_name,
CAST(f.p_partkey IS NOT NULL AS BIGINT) AS alert_exists FROM wanted w LEFT JOIN found f ON f.p_size = w.message_id AND f.severity = w.severity""")
def _(t):
    wanted = t.part.select(F.lit("d").alias("description"), F.col("p_size").cast("int").alias("message_id"), (F.col("p_partkey") % 5).cast("int").alias("severity")).distinct()
    found = _instance(t, 10, {"message_id": F.col("p_size"), "severity": F.col("p_partkey") % 7}).filter("category % 3 = 0")
    return _show(views.build("agent_alerts", {"seed_agent_alerts": wanted, "instance_state": found}, _now()), "message_id, severity, alert_name, alert_exists")


@check("view_instance_configurations", f"""WITH checked AS (SELECT p_partkey, p_size FROM part WHERE p_partkey IN {views.CHECKED_CONFIGURATIONS})
SELECT p_partkey AS configuration_id, 'c' AS name, CAST(p_size AS BIGINT) AS value, CAST(p_size BETWEEN 10 AND 40 AS BIGINT) AS state FROM checked""")
def _(t):
    version = _instance(t, 3, {"ProductMajorVersion": F.lit(15), "ProductMinorVersion": F.lit(0)}).filter("category = '1'")
    states = _instance(t, 4, {"name": F.lit("c"), "value_in_use": F.col("p_size")}).unionByName(version)
    bounds = t.part.select(F.col("p_partkey").cast("int").alias("configuration_id"), F.explode(F.array(F.lit(14), F.lit(15))).alias("product_major"),
                           F.lit(0).alias("product_minor"), F.lit(10).alias("minimum"), F.lit(40).alias("maximum"))
    return _show(views.build("instance_configurations", {"instance_state": states, "seed_configurations": bounds}, _now()), "configuration_id, name, value, state")


@check("view_instance_hardware", """SELECT CAST(p_partkey AS VARCHAR) AS category, k.label, k.shown AS value_text FROM part,
LATERAL (VALUES ('Physical memory MB', CAST(p_partkey * 1000 // 1024 AS VARCHAR)),
  ('SQL memory model', CASE p_size % 4 WHEN 1 THEN 'CONVENTIONAL' WHEN 2 THEN 'LOCK_PAGES' WHEN 3 THEN 'LARGE_PAGES' ELSE '?:0' END),
  ('Virtual machine type', CASE p_size % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'HYPERVISOR' ELSE 'OTHER' END),
  ('CPU count', CAST(p_size AS VARCHAR))) AS k(label, shown)""")
def _(t):
    states = _instance(t, 17, {"physical_memory_kb": F.col("p_partkey") * 1000, "sql_memory_model": F.col("p_size") % 4,
                               "virtual_machine_type": F.col("p_size") % 3, "cpu_count": F.col("p_size")})
    return _show(views.build("instance_hardware", {"instance_state": states}, _now()), "category, label, value_text")


@check("view_memory_clerks", """SELECT ['MEMORYCLERK_SQLBUFFERPOOL', 'MEMORYCLERK_SQLCONNECTIONPOOL', 'OBJECTSTORE_LOCK_MANAGER'][CAST(user_id % 5 AS INTEGER) + 1] AS name, count(*) AS n
FROM events WHERE user_id % 5 < 3 GROUP BY 1""")
def _(t):
    name = F.element_at(F.array(*[F.lit(x) for x in (*views.MEMORY_CLERKS, "OTHER", "MORE")]), (F.col("user_id") % 5 + 1).cast("int"))
    clerks = t.events.select(name.alias("name"), F.col("event_id").alias("value"), F.col("ts").alias("ts_utc"), "ts")
    return views.build("memory_clerks", {"memory_clerks": clerks}, _now()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
