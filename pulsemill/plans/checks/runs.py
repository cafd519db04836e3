"""Run histories, schedules and XML events: J."""

from pyspark.sql import DataFrame, functions as F

from ...operators import events_xml, runs
from ...session import scratch_dir
from ..job_rollup import RollupStore, gains
from . import HISTORY, SCHEDULES, at, check
from .columns import SCHEDULE_TEXT, key_sql

_RUNS = f"""{HISTORY},
r AS (SELECT *, lag(seq, 1, -1) OVER w AS prev_seq, lead(seq, 1, 9223372036854775807) OVER w AS next_seq FROM hist WHERE step = 0 WINDOW w AS (PARTITION BY job ORDER BY seq))"""


@check("j1_runs_from_history", f"""WITH {_RUNS}
SELECT job, seq, CAST(status AS BIGINT) AS job_status, CAST(coalesce((SELECT min(h.status) FROM hist h WHERE h.job = r.job AND h.status <> 1 AND h.seq > r.prev_seq AND h.seq <= r.seq), 1) AS BIGINT) AS steps_status,
{at('started')} AS started, CASE WHEN duration_s = 0 THEN 1 ELSE duration_s END AS duration_s FROM r
WHERE EXISTS (SELECT 1 FROM hist h WHERE h.job = r.job AND h.step <> 0 AND h.step < 4 AND h.seq > r.prev_seq AND h.seq < r.next_seq)""")
def _(t):
    return runs.runs_from_history(t.history, "job", "seq", "step", "status", "started", "duration_s", wanted=F.col("step") < 4, width=1000)


_ROLLUP_SQL = f"""WITH {_RUNS},
x AS (SELECT job, status, coalesce((SELECT min(h.status) FROM hist h WHERE h.job = r.job AND h.status <> 1 AND h.seq > r.prev_seq AND h.seq <= r.seq), 1) AS steps_status, started,
 CASE WHEN duration_s = 0 THEN 1 ELSE duration_s END AS d FROM r WHERE EXISTS (SELECT 1 FROM hist h WHERE h.job = r.job AND h.step <> 0 AND h.seq > r.prev_seq AND h.seq < r.next_seq))
SELECT CAST(job AS VARCHAR) AS name, CAST(status AS BIGINT) AS job_status, CAST(steps_status AS BIGINT) AS steps_status, strftime(started, '%Y-%m-%d') AS date,
hour(started) AS hour, count(*) AS cnt, CAST(sum(d) AS BIGINT) AS sum_s, min(d) AS min_s, max(d) AS max_s FROM x GROUP BY 1, 2, 3, 4, 5"""


@check("j_job_rollup_two_steps", _ROLLUP_SQL)
def _(t):
    """The rollup in two steps; a crash between them leaves a batch without a commit."""
    history = t.history.withColumns({"job": F.col("job").cast("string"), "status": F.col("status").cast("int")})
    half = history.filter(F.col("seq") < t.history.select(F.max("seq") / 2).scalar())
    store = RollupStore(t.spark, scratch_dir(t.spark, "job-rollup"))
    store.advance(half)
    for name in RollupStore.PARTS[:3]:
        getattr(gains(history, store.read()), name).write.parquet(f"{store.root}/{name}/batch=1")
    store.advance(history)
    return store.read().rollup


@check("j3_failed_steps", f"""WITH {HISTORY}
SELECT h.seq, h.job, CAST(h.status AS BIGINT) AS status, p.duration_s AS job_duration_s FROM hist h ASOF JOIN (SELECT * FROM hist WHERE step = 0) p ON h.job = p.job AND h.seq > p.seq
WHERE h.step <> 0 AND h.status NOT IN (1, 4)""")
def _(t):
    return runs.failed_steps(t.history, "job", "seq", "step", "status", "duration_s").select("seq", "job", "status", "job_duration_s")


_SLOT_TEST = """(subday_type = 1 AND n = h0) OR (subday_type IN (2, 4) AND n BETWEEN h0 AND h1)
 OR (subday_type = 8 AND n BETWEEN h0 AND h1 AND (n - h0) % subday_interval = 0)"""
_GRID = ", ".join(f"max(CASE WHEN n = {h} THEN day_text END) AS h{h:02d}" for h in range(24))


@check("j4_schedule_grid", f"""WITH {SCHEDULES}, txt AS (SELECT *, {SCHEDULE_TEXT} FROM sched)
SELECT job, schedule_id, when_text, detail_text, active_text, {_GRID} FROM txt, range(24) AS r(n)
WHERE freq_type IN (4, 8) AND end_date >= DATE '2001-01-01' AND ({_SLOT_TEST}) GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return runs.schedule_grid(t.schedules, F.lit("2001-01-01").cast("date"))


@check("j5_not_scheduled", f"WITH {SCHEDULES} SELECT job FROM sched WHERE schedule_id = 0")
def _(t):
    return runs.not_scheduled(t.schedules.withColumn("schedule_id", F.nullif("schedule_id", F.lit(0)))).select("job")


def _process(spid, host, app, login, db, buffer, frames=None):
    attrs = [(k, v) for k, v in (("spid", spid), ("hostname", host), ("clientapp", app), ("loginname", login), ("currentdbname", db))]
    head = F.concat(*[p for k, v in attrs for p in (F.lit(f' {k}="'), v, F.lit('"'))])
    stack = F.lit("") if frames is None else F.concat(F.lit("<executionStack>"), frames, F.lit("</executionStack>"))
    return F.concat(F.lit("<process"), head, F.lit(">"), stack, F.lit("<inputbuf>"), buffer, F.lit("</inputbuf></process>"))


def xml_events(t) -> DataFrame:
    """Clicks and views as blocked-process reports, errors as deadlocks; the rest as another event."""
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    user, other = s("user_id"), s(F.col("event_id") % 150)
    mine = (user, F.concat(F.lit("h"), s(F.col("user_id") % 7)), F.col("event_type"), F.concat(F.lit("u"), user), F.lit("main"))
    theirs = (other, F.concat(F.lit("h"), s(F.col("event_id") % 5)), F.lit("batch"), F.concat(F.lit("u"), other), F.lit("main"))
    text = F.concat(F.lit("\nrun "), F.col("props"))
    side = lambda tag, p: F.concat(F.lit(f"<{tag}>"), _process(*p, text), F.lit(f"</{tag}>"))
    blocked = F.concat(F.lit('<event name="blocked_process_report"><data name="duration"><value>5</value></data><data name="blocked_process"><value><blocked-process-report monitorLoop="1">'),
                       side("blocked-process", mine), side("blocking-process", theirs), F.lit("</blocked-process-report></value></data></event>"))
    frames = F.concat(F.lit("<frame>\nfirst "), s("event_id"), F.lit("</frame><frame>second</frame>"))
    deadlock = F.concat(F.lit('<event name="xml_deadlock_report"><data name="xml_report"><value><deadlock><victim-list/><process-list>'),
                        _process(*mine, text, frames), _process(*theirs, text, frames), F.lit("</process-list></deadlock></value></data></event>"))
    kind = F.col("event_type")
    data = (F.when(kind.isin("click", "view"), blocked).when(kind == "error", deadlock).when(kind == "signup", '<event name="other"/>')
            .otherwise("<event name="))
    return t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("event_ts"), data.alias("event_data"))


def _sides(kinds: str) -> str:
    return f"""mine AS (SELECT event_id, ts, user_id AS spid, 'h' || user_id % 7 AS host_name, event_type AS client_app, 'u' || user_id AS login_name, 'run ' || props AS statement, event_id % 150 AS other FROM events WHERE event_type IN ({kinds})),
theirs AS (SELECT event_id, ts, event_id % 150 AS spid, 'h' || event_id % 5 AS host_name, 'batch' AS client_app, 'u' || event_id % 150 AS login_name, 'run ' || props AS statement, user_id AS other FROM events WHERE event_type IN ({kinds})),
both_sides AS (SELECT 'Blocked' AS type, * FROM mine UNION ALL SELECT 'Blocking', * FROM theirs)"""


_BLOCKED, _DEADLOCKED = _sides("'click', 'view'"), _sides("'error'")


@check("j7_blocked_processes", f"WITH {_BLOCKED} SELECT event_id AS data_set, {at('ts')} AS event_ts, type, spid, host_name, client_app, login_name, 'main' AS database, statement FROM both_sides WHERE spid <> other")
def _(t):
    return events_xml.blocked_processes(xml_events(t))


@check("j7_blocked_processes_bounded", f"""WITH {_BLOCKED},
sets AS (SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id <> event_id % 150 AND date_diff('day', ts, (SELECT max(ts) FROM events)) < 7 ORDER BY ts DESC LIMIT 100)
SELECT event_id AS data_set, type, spid FROM both_sides WHERE event_id IN (SELECT event_id FROM sets)""")
def _(t):
    return events_xml.blocked_processes(xml_events(t), days=7, sets=100).select("data_set", "type", "spid")


@check("j8_deadlock_participants", f"WITH {_DEADLOCKED} SELECT event_id AS data_set, {at('ts')} AS event_ts, spid, host_name, client_app, login_name, 'main' AS database, statement, 'first ' || event_id AS frame FROM both_sides")
def _(t):
    return events_xml.deadlock_participants(xml_events(t))


_WHO = key_sql("upper(client_app || chr(31) || host_name || chr(31) || login_name)")


@check("j9_participants", f"""WITH w AS (SELECT event_type AS client_app, 'h' || user_id % 7 AS host_name, 'u' || user_id AS login_name FROM events WHERE event_type = 'error' OR (event_type IN ('click', 'view') AND user_id <> event_id % 150)
UNION SELECT 'batch', 'h' || event_id % 5, 'u' || event_id % 150 FROM events WHERE event_type = 'error' OR (event_type IN ('click', 'view') AND user_id <> event_id % 150))
SELECT *, {_WHO} AS participant_key FROM w""")
def _(t):
    e = xml_events(t)
    return events_xml.participants(events_xml.blocked_processes(e), events_xml.deadlock_participants(e))


@check("j6_ring_buffer", f"""SELECT event_id AS record_id, {at("TIMESTAMP '2024-02-01 00:00:00' - INTERVAL (20000000 - event_id * 1000) MILLISECOND")} AS event_ts,
user_id % 100 AS process_utilization, 100 - user_id % 100 AS system_idle, event_id * 2 AS page_faults FROM events WHERE event_type <> 'error'""")
def _(t):
    s = lambda c: c.cast("string")
    health = F.when(F.col("event_type") == "error", "<Other/>").otherwise(F.concat(
        F.lit("<SystemHealth><ProcessUtilization>"), s(F.col("user_id") % 100), F.lit("</ProcessUtilization><SystemIdle>"), s(100 - F.col("user_id") % 100),
        F.lit("</SystemIdle><PageFaults>"), s(F.col("event_id") * 2), F.lit("</PageFaults></SystemHealth>")))
    xml = F.concat(F.lit('<Record id="'), s(F.col("event_id")), F.lit('" type="X"><SchedulerMonitorEvent>'), health, F.lit("</SchedulerMonitorEvent></Record>"))
    r = t.events.select(xml.alias("record"), (F.col("event_id") * 1000).alias("ticks"))
    return events_xml.ring_buffer(r, "record", "ticks", F.lit(20_000_000), F.lit("2024-02-01 00:00:00").cast("timestamp"))


@check("j_malformed_xml", "SELECT count(*) AS malformed FROM events WHERE event_type = 'purchase'")
def _(t):
    return events_xml.malformed(xml_events(t))
