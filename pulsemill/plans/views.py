"""Report views as presets: column names and parameters over the operators.

``build(name, tables, now, options)`` gives one view.  ``tables`` maps the
canonical names of ``sources.schemas.SHAPES`` to DataFrames; only those a view
needs are looked at.  ``now`` is a stated timestamp.  ``options`` override the
bounds of reports (``OPTIONS``: days, hours, sets, rows, text length); 0 lifts
a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as c, text as x
from ..operators import aggregate, chunked, counters, events_xml, joins, model, reshape, runs, select, state

View = Callable[[Mapping[str, DataFrame], Column], DataFrame]
VIEWS: dict[str, View] = {}

_LEVELS = ("database", "schema", "object", "index")
_NO_INDEX = {"index": "N.A."}


def view(name: str):
    def register(fn: View) -> View:
        VIEWS[name] = fn
        return fn
    return register


# The bounds of reports.
OPTIONS = {
    "blocked_process.days": 7, "blocked_process.sets": 500, "deadlock.days": 7, "deadlock.sets": 500,
    "log.days": 1, "log.rows": 10_000, "log_non_debug_info.days": 7, "log_non_debug_info.rows": 1000,
    "memory_grants_pending.rows": 25, "who_is_active.hours": 24, "who_is_active.rows": 1000,
    "error_logs.rows": 1000, "log_messages.rows": 1000, "text.length": 1000,
}


class Inputs(dict):
    """The tables of a view, and its options."""

    def __init__(self, tables: Mapping[str, DataFrame], options: Mapping[str, int] | None = None):
        super().__init__(tables)
        if unknown := set(options or {}) - set(OPTIONS):
            raise ValueError(f"unknown options {sorted(unknown)}")
        self.options = {**OPTIONS, **(options or {})}

    def text(self, name: str) -> Column:
        """A text cut to the option's length."""
        n = self.options["text.length"]
        return c.truncate_text(name, n) if n else F.col(name)


def build(name: str, tables: Mapping[str, DataFrame], now: Column, options: Mapping[str, int] | None = None) -> DataFrame:
    return VIEWS[name](Inputs(tables, options), now)


def keyed(df: DataFrame, ts: str | None = "ts", **more: Sequence[str]) -> DataFrame:
    """B1 and K5: date, time key, and the keys of the levels the rows have."""
    levels = [lv for lv in _LEVELS if lv in df.columns]
    specs = [model.KeySpec(f"{lv}_key", levels[:i], _NO_INDEX if lv == "index" else {}) for i, lv in enumerate(levels, 1)
             if levels[:i] == list(_LEVELS[:i])]
    specs += [model.KeySpec(n, cols) for n, cols in more.items()]
    df = c.date_time_key(df, ts) if ts else df
    return model.attach_keys(df, specs)


def with_yes_no(df: DataFrame, *flags: str) -> DataFrame:
    return df.withColumns({f"{f}_text": c.yes_no(f) for f in flags})


# -- statistics age ---------------------------------------------------------

def _statistics(t, now, incremental: bool):
    rows = select.latest_snapshot(t["statistics_age"], "ts").filter(F.col("last_updated").isNotNull())
    rows = rows.filter(F.col("partition").isNotNull() if incremental else F.col("partition").isNull())
    return keyed(with_yes_no(rows.withColumn("age_days", c.age("day", "last_updated", now)), "is_hypothetical"))


VIEWS["statistics_age"] = partial(_statistics, incremental=False)
VIEWS["statistics_age_incremental"] = partial(_statistics, incremental=True)


@view("statistics_age_detailed")
def _(t, now):
    rows = t["statistics_age"].filter(F.col("last_updated").isNotNull() & F.col("partition").isNull())
    return keyed(rows.withColumn("age_days", c.age("day", "last_updated", "ts")))


# -- jobs -------------------------------------------------------------------

def _today(now):
    return F.to_date(now)


@view("agent_jobs_grid")
def _(t, now):
    return keyed(runs.schedule_grid(select.latest_snapshot(t["job_schedules"], "ts_utc"), _today(now), ("job", "schedule_id", "enabled")),
                 None, job_key=["job"])


@view("agent_jobs_list")
def _(t, now):
    latest = select.latest_snapshot(t["job_schedules"], "ts_utc").filter(F.col("schedule_id").isNotNull())
    return keyed(with_yes_no(latest.withColumns(x.schedule_text()), "enabled"), None, job_key=["job"])


@view("agent_jobs_not_scheduled")
def _(t, now):
    return keyed(runs.not_scheduled(select.latest_snapshot(t["job_schedules"], "ts_utc")), None, job_key=["job"])


@view("agent_jobs_performance")
def _(t, now):
    rollup = t["hourly_rollup"].withColumns({
        "time_key": F.col("hour") * 3600, "outcome_key": runs.outcome_key(F.col("job_status"), F.col("steps_status"))})
    return keyed(rollup, None, job_key=["name"])


@view("agent_jobs_performance_errors")
def _(t, now):
    rows = t["job_step_errors"].filter(F.col("status") != runs.IN_PROGRESS)
    return keyed(rows.withColumn("outcome_key", runs.outcome_key(F.col("status"), F.lit(runs.FAILED))), "started", job_key=["job"])


@view("agent_job_status")
def _(t, now):
    return model.dimension_rows(next(iter(t.values())).sparkSession, runs.OUTCOMES, "outcome_key", "status")


# -- backups ----------------------------------------------------------------

# Backup types and recovery models.
BACKUP_TYPES = {"D": "Database", "I": "Differential database", "L": "Log", "F": "File/filegroup", "G": "Differential file",
                "P": "Partial", "Q": "Differential partial"}
RECOVERY_MODELS = {"1": "Full", "2": "Bulk logged", "3": "Simple"}


@view("backup_age")
def _(t, now):
    model_rows = select.current_rows(t["database_state"]).filter("query = 31 AND key = 'recovery_model' AND database <> 'tempdb'")
    since = model_rows.select("database", F.col("ts_utc").alias("model_since_utc"), F.col("ts").alias("_since"),
                              c.decode("value", RECOVERY_MODELS).alias("recovery_model"))
    good = t["backups"].filter("NOT copy_only AND NOT damaged")
    latest = aggregate.by_type(good, "database", "type", {"full": "D", "diff": "I", "log": "L"}, F.max, "start")
    both = since.join(latest, "database", "left")
    # A backup from before the recovery model changed does not count.
    valid = lambda k: F.when(F.col(k) > F.col("_since"), F.col(k))
    never = F.lit("1900-01-01").cast("timestamp")
    logged = F.col("recovery_model").isin("Full", "Bulk logged")
    counted = {"full": F.coalesce(valid("full"), never), "diff": F.when(F.col("diff").isNotNull(), F.coalesce(valid("diff"), never)),
               "log": F.when(logged, F.coalesce(valid("log"), never))}
    hours = {f"{k}_age_hours": F.floor(c.datediff_boundary("minute", col, now) / 60) for k, col in counted.items()}
    shown = {f"latest_{k}": F.nullif(col, never) for k, col in counted.items()}
    return keyed(both.select("database", "recovery_model", "model_since_utc", *[v.alias(n) for n, v in {**shown, **hours}.items()]), None)


@view("backup_status")
def _(t, now):
    event = ["database", "type", "start", "finish", "size", "compressed", "copy_only", "damaged", "ts"]
    rows = aggregate.collapse(t["backups"], event)
    rows = rows.withColumns({"duration_s": c.at_least_one(c.datediff_boundary("second", "start", "finish")),
                             "type_text": F.coalesce(c.decode("type", BACKUP_TYPES), F.lit("?:<NULL>")),
                             "_category": F.lit("1")})
    return keyed(with_yes_no(rows, "copy_only", "damaged"), "ts", backup_type_key=["_category", "type"]).drop("_category")


@view("junk_dimensions")
def _(t, now):
    spark = next(iter(t.values())).sparkSession
    rows = reshape.inline_table(spark, "category string, type string, name string", [("1", k, v) for k, v in BACKUP_TYPES.items()])
    return model.attach_keys(rows, [model.KeySpec("junk_key", ["category", "type"])])


# -- events -----------------------------------------------------------------

_WHO = ["client_app", "host_name", "login_name"]


def _bounded(t, name, events):
    return events(t["xml_events"], days=t.options[f"{name}.days"], sets=t.options[f"{name}.sets"])


@view("blocked_process")
def _(t, now):
    return keyed(_bounded(t, "blocked_process", events_xml.blocked_processes), "event_ts", participant_key=_WHO)


@view("deadlock")
def _(t, now):
    return keyed(_bounded(t, "deadlock", events_xml.deadlock_participants), "event_ts", participant_key=_WHO)


@view("blocks_and_deadlocks")
def _(t, now):
    """A dimension: participants of all events, whatever bounds the facts have."""
    return events_xml.participants(events_xml.blocked_processes(t["xml_events"]), events_xml.deadlock_participants(t["xml_events"]))


# -- processor --------------------------------------------------------------

@view("cpu_utilization")
def _(t, now):
    rest = c.other_share("process_utilization", "system_idle")
    return keyed(t["cpu_utilization"].withColumn("other_utilization", rest), "event_ts")


@view("cpu_per_database")
def _(t, now):
    deltas = counters.counter_delta(t["cpu_per_database"], "database", "ts_utc", ["cpu_ms"], **counters.DELTA_RULES["cpu_per_database"])
    return keyed(aggregate.share_of_total(deltas, "delta_cpu_ms", "ts_utc", "cpu_share", ["database"]))


# -- capacity ---------------------------------------------------------------

# Allocation unit types and file types.
UNIT_TYPES = {0: "Dropped", 1: "IN_ROW_DATA", 2: "LOB_DATA", 3: "ROW_OVERFLOW_DATA"}
FILE_TYPES = {0: "Data", 1: "Log", 2: "Filestream", 4: "Fulltext"}


def _file_type() -> Column:
    known = F.create_map(*[F.lit(v) for kv in FILE_TYPES.items() for v in kv])
    return F.coalesce(F.try_element_at(known, F.col("type").cast("int")), F.lit("Other"))


@view("allocation_units")
def _(t, now):
    pages = ["total_pages", "used_pages", "data_pages"]
    rows = select.any_nonzero(select.latest_snapshot(t["allocation_units"], "ts_utc"), pages)
    rows = rows.withColumns({p.replace("pages", "kb"): c.pages_to_kb(p) for p in pages})
    known = F.create_map(*[F.lit(v) for kv in UNIT_TYPES.items() for v in kv])
    return keyed(rows.withColumn("unit_type_text", F.try_element_at(known, F.col("unit_type").cast("int"))), None,
                 filegroup_key=["database", "filegroup"])


@view("database_size")
def _(t, now):
    rows = select.last_snapshot_per_day(t["file_sizes"], "ts").withColumn("type_text", _file_type())
    return keyed(rows, "ts", file_key=["database", "logical", "physical", "type_text", "filegroup"], disk_key=["mount"],
                 filegroup_key=["database", "filegroup"])


@view("disk_size")
def _(t, now):
    return keyed(select.last_snapshot_per_day(t["disk_sizes"], "ts"), "ts", disk_key=["mount"])


@view("partitioned_indexes")
def _(t, now):
    index = ["ts", *_LEVELS]
    rows = select.last_snapshot_per_day(t["partitioned_indexes"], "ts")
    # Partitions of one index number from 1; a chunk holds 15 000 of them.
    by = chunked.by_range("partition", 15_000)
    rows = chunked.with_previous(rows, index, "partition", {"_before": "boundary"}, by)
    rows = chunked.with_next(rows, index, "partition", {"_after": "boundary"}, by)
    covers = c.range_text("partition_column", "boundary", "_before", "_after", "boundary_on_right")
    rows = rows.withColumn("partition_range", covers).drop("_before", "_after")
    last = F.when(F.col("boundary").isNull(), F.when(F.col("boundary_on_right"), 1).otherwise(2)).otherwise(
        F.when(F.col("boundary_on_right"), 2).otherwise(1))
    order = [F.col("ts").desc(), *_LEVELS, last, F.col("boundary")]
    rows = chunked.number_rows(rows, order, "sort_order")
    return keyed(rows, "ts", filegroup_key=["database", "filegroup"])


@view("table_size")
def _(t, now):
    return keyed(select.last_snapshot_per_day(t["table_sizes"], "ts"))


@view("vlf_size")
def _(t, now):
    return keyed(select.last_snapshot_per_day(t["vlf_sizes"], "ts"))


# -- connections ------------------------------------------------------------

def _scheme(df: DataFrame) -> DataFrame:
    mirrored = F.col("protocol") == "Database Mirroring"
    return df.withColumn("scheme", F.when(mirrored, "Database Mirroring Endpoint communication").otherwise(F.col("auth_scheme")))


@view("connection_info")
def _(t, now):
    return model.attach_keys(_scheme(t["connections"]).select("scheme").distinct(), [model.KeySpec("connection_key", ["scheme"])])


@view("connections")
def _(t, now):
    return keyed(_scheme(t["connections"]), "ts", connection_key=["scheme"])


@view("sessions")
def _(t, now):
    return keyed(t["sessions"], "ts", session_key=["host", "program", "login"])


# -- deltas -----------------------------------------------------------------

@view("database_io")
def _(t, now):
    io = ["reads", "bytes_read", "stall_read_ms", "writes", "bytes_written", "stall_write_ms"]
    d = counters.counter_delta(t["file_io"], ["database", "file", "type"], "ts_utc", io, **counters.DELTA_RULES["database_io"])
    d = counters.with_latency(d, "delta_stall_read_ms", "delta_reads", "read_latency_ms")
    d = counters.with_latency(d, "delta_stall_write_ms", "delta_writes", "write_latency_ms")
    return keyed(d.withColumn("type_text", _file_type()), "ts", file_key=["database", "file", "type_text"])


@view("wait_statistics")
def _(t, now):
    d = counters.counter_delta(t["wait_counters"], "wait_type", "ts_utc", ["sum_wait_ms", "sum_signal_ms", "tasks"],
                               **counters.DELTA_RULES["wait_statistics"])
    return keyed(d, "ts", wait_key=["wait_type"])


_USES = ["seeks", "scans", "lookups", "updates"]


def _index_deltas(t) -> DataFrame:
    return counters.counter_delta(t["index_usage"], list(_LEVELS), "ts_utc", _USES, **counters.DELTA_RULES["index_usage"])


@view("index_usage")
def _(t, now):
    return keyed(_index_deltas(t))


@view("index_not_used")
def _(t, now):
    named = select.latest_snapshot(t["index_usage"], "ts_utc").filter(F.col("index").isNotNull()).select(*_LEVELS)
    return keyed(named.join(_index_deltas(t).select(*_LEVELS), list(_LEVELS), "left_anti"), None)


@view("index_configuration")
def _(t, now):
    rows = select.latest_snapshot(t["index_state"], "ts_utc")
    rows = joins.group_flag(rows, list(_LEVELS[:3]), F.col("index_type") == 0, "table_is_heap", ["index"])
    return keyed(with_yes_no(rows, "is_unique", "is_primary_key", "is_disabled", "has_filter", "table_is_heap"))


@view("index_operational")
def _(t, now):
    counted = ["leaf_inserts", "leaf_deletes", "leaf_updates", "range_scans", "singleton_lookups", "lock_waits",
               "lock_wait_ms", "latch_waits", "latch_wait_ms"]
    return keyed(counters.counter_delta(t["index_operational"], list(_LEVELS), "ts_utc", counted, **counters.DELTA_RULES["index_operational"]))


@view("missing_indexes")
def _(t, now):
    rows = select.drop_sentinels(t["missing_indexes"], {"database": "", "schema": "", "object": ""})
    entity = ["database", "schema", "object", "query_hash", "equality", "inequality", "included"]
    d = counters.counter_delta(rows, entity, "ts_utc", ["seeks", "scans"], **counters.DELTA_RULES["missing_indexes"])
    return keyed(d, "ts", statement_key=["database", "query_hash"])


@view("missing_index_statement")
def _(t, now):
    return _statements(t)


def _statements(t) -> DataFrame:
    newest = chunked.newest_per_group(t["statements"], ["database", "query_hash"], "ts_utc")
    rows = newest.withColumns({"query_hash": c.hex_key("query_hash"), "statement": t.text("statement")})
    return keyed(rows, None, statement_key=["database", "query_hash"])


@view("query_statements")
def _(t, now):
    return _statements(t)


_QUERY_COUNTERS = ["executions", "worker_ms", "logical_reads", "elapsed_ms", "rows"]


def _query_deltas(t, keys, plan):
    return counters.query_deltas(t["query_counters"], keys, plan, "ts_utc", _QUERY_COUNTERS, epoch="restart_ts")


@view("query_statistics")
def _(t, now):
    d = _query_deltas(t, ["database", "query_hash"], ["plan", "created"])
    return keyed(d.withColumn("query_hash", c.hex_key("query_hash")), "ts_utc", statement_key=["database", "query_hash"])


@view("query_statistics_stored_procedures")
def _(t, now):
    return keyed(_query_deltas(t, "database", ["query_hash", "plan", "created"]), "ts_utc")


# -- maintenance and index scans --------------------------------------------

def _maintenance(df: DataFrame) -> DataFrame:
    return df.withColumns({"kind": c.classify_command("command_type", "command"),
                           "duration_s": c.at_least_one(c.datediff_boundary("second", "started", "ended"))})


@view("index_optimize")
def _(t, now):
    return keyed(_maintenance(t["maintenance_log"]), "started")


@view("maintenance_errors")
def _(t, now):
    return keyed(_maintenance(t["maintenance_log"].filter("error_number <> 0 OR error_message IS NOT NULL")), "started")


# Scan modes, the most detailed first.
SCAN_MODES = ("DETAILED", "SAMPLED", "LIMITED")
_OBJECT = list(_LEVELS[:3])  # the mode is chosen for an object, for all its indexes


@view("index_physical")
def _(t, now):
    return keyed(select.best_mode_rows(t["index_physical"], _OBJECT, "mode", SCAN_MODES, "ts_utc", 24))


@view("index_physical_detailed")
def _(t, now):
    return keyed(select.prefer_detail_per_day(t["index_physical"], _OBJECT, "mode", SCAN_MODES, "ts_utc"))


# -- current state ----------------------------------------------------------

FLAG, FLAG_OR_NULL, INT, TEXT, DISPLAY = "flag", "flag_or_null", "int", "text", "display"


@dataclass(frozen=True)
class StateView:
    """Open state rows of one query, pivoted; how each key is shown."""
    table: str
    query: int
    group: Sequence[str]
    keys: Mapping[str, str | Mapping[str, str]]
    key_columns: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def __call__(self, t: Mapping[str, DataFrame], now: Column) -> DataFrame:
        rows = select.current_rows(t[self.table]).filter(F.col("query") == self.query)
        wide = reshape.pivot_state(rows, self.group, list(self.keys), extra={"min_ts": F.min("ts"), "max_ts": F.max("ts")})
        for k, kind in self.keys.items():
            if isinstance(kind, Mapping):
                wide = wide.withColumn(k, c.decode(k, kind))
            elif kind == INT:
                wide = wide.withColumn(k, F.col(k).try_cast("bigint"))
            elif kind == DISPLAY:
                wide = wide.withColumn(k, c.display_text(k))
            elif kind in (FLAG, FLAG_OR_NULL):
                flag = F.col(k).try_cast("boolean")
                text = c.yes_no(flag) if kind == FLAG else F.when(flag.isNotNull(), c.yes_no(flag))
                wide = wide.withColumns({k: flag, f"{k}_text": text})
        return keyed(wide, None, **self.key_columns)


_AG, _LS = ["group_a", "group_b"], "log_shipping_state"
# Code lists of the database state.
DURABILITY = {"0": "Disabled", "1": "Allowed", "2": "Forced"}
PAGE_VERIFY = {"0": "None", "1": "Torn page detection", "2": "Checksum"}
DATABASE_STATES = {"0": "Online", "1": "Restoring", "2": "Recovering", "3": "Recovery pending", "4": "Suspect",
                   "5": "Emergency", "6": "Offline", "7": "Copying", "10": "Offline secondary"}
DATABASE_KEYS = {
    "collation_name": TEXT, "compatibility_level": INT, "database_owner": TEXT, "delayed_durability": DURABILITY,
    "is_auto_close_on": FLAG, "is_auto_shrink_on": FLAG, "is_auto_update_stats_async_on": FLAG, "is_encrypted": FLAG,
    "is_in_standby": FLAG, "is_mixed_page_allocation_on": FLAG, "is_parameterization_forced": FLAG,
    "is_read_committed_snapshot_on": FLAG, "is_read_only": FLAG, "is_trustworthy_on": FLAG, "page_verify_option": PAGE_VERIFY,
    "recovery_model": RECOVERY_MODELS, "state": DATABASE_STATES, "target_recovery_time_in_seconds": INT,
    "replica_id": TEXT, "AlwaysOnGroupName": TEXT, "IsOnAlwaysOnPrimary": INT}

# The keys of each state view.
STATE_VIEWS = {
    "always_on_database_states": StateView("always_on_state", 6, ["group_a", "group_b", "group_c"], {
        "database_state_desc": DISPLAY, "is_commit_participant": FLAG_OR_NULL, "is_local": FLAG, "is_primary_replica": FLAG,
        "is_suspended": FLAG_OR_NULL, "suspend_reason_desc": DISPLAY, "synchronization_health_desc": DISPLAY,
        "synchronization_state_desc": DISPLAY}, {"ag_key": ["group_a"], "replica_key": _AG}),
    "always_on_group_states": StateView("always_on_state", 3, ["group_a"], {
        "primary_recovery_health_desc": DISPLAY, "secondary_recovery_health_desc": DISPLAY,
        "synchronization_health_desc": DISPLAY}, {"ag_key": ["group_a"]}),
    "always_on_read_only_routing": StateView("always_on_state", 4, ["group_a", "group_b", "group_c"], {
        "read_only_routing_url": TEXT, "routing_priority": INT, "secondary_role_allow_connections_desc": DISPLAY},
        {"ag_key": ["group_a"], "replica_key": _AG}),
    "always_on_replicas": StateView("always_on_state", 5, _AG, {
        "availability_mode_desc": DISPLAY, "backup_priority": INT, "endpoint_url": TEXT, "failover_mode_desc": DISPLAY,
        "primary_role_allow_connections_desc": DISPLAY, "read_only_routing_url": TEXT, "read_write_routing_url": TEXT,
        "secondary_role_allow_connections_desc": DISPLAY}, {"ag_key": ["group_a"], "replica_key": _AG}),
    "wsfc_quorum_members": StateView("always_on_state", 2, ["group_a"], {
        "member_state_desc": DISPLAY, "member_type_desc": DISPLAY, "number_of_current_votes": INT, "number_of_quorum_votes": INT}),
    "wsfc_quorum_state": StateView("always_on_state", 1, ["group_a"], {
        "cluster_name": TEXT, "quorum_state_desc": DISPLAY, "quorum_type_desc": DISPLAY}),
    "database_state": StateView("database_state", 31, ["database"], DATABASE_KEYS),
    "log_shipping_monitor_primary_database_state": StateView(_LS, 11, _AG, {
        "backup_threshold": INT, "threshold_alert": INT, "history_retention_period": INT}),
    "log_shipping_monitor_secondary_database_state": StateView(_LS, 12, _AG, {
        "primary_server": TEXT, "primary_database": TEXT, "restore_threshold": INT, "threshold_alert": INT,
        "threshold_alert_enabled": FLAG, "history_retention_period": INT}),
    "log_shipping_primary_database_state": StateView(_LS, 21, _AG, {
        "backup_directory": TEXT, "backup_share": TEXT, "backup_retention_period": INT, "monitor_server": TEXT,
        "user_specified_monitor": FLAG, "monitor_server_security_mode": INT, "backup_compression": INT}),
    "log_shipping_secondary_database_state": StateView(_LS, 31, _AG, {
        "restore_delay": INT, "restore_all": FLAG, "restore_mode": INT, "disconnect_users": FLAG, "block_size": INT,
        "buffer_count": INT, "max_transfer_size": INT}),
    "log_shipping_secondary_primary_database_state": StateView(_LS, 32, ["group_a", "group_b", "group_c"], {
        "backup_source_directory": TEXT, "backup_destination_directory": TEXT, "file_retention_period": INT,
        "monitor_server": TEXT, "monitor_server_security_mode": INT, "user_specified_monitor": FLAG}),
    "agent_jobs": StateView("instance_state", 9, ["category"], {
        "job_enabled": FLAG, "number_of_enabled_schedules": INT, "job_owner": TEXT, "notify_email_operator_id": INT,
        "notify_level_email": INT}, {"job_key": ["category"]}),
    "instance_dump_files": StateView("instance_state", 21, ["category"], {
        "creation_time": TEXT, "filename": TEXT, "size_in_bytes": INT}),
    "instance_services": StateView("instance_state", 7, ["category"], {
        "startup_type": TEXT, "status": TEXT, "service_account": TEXT, "instant_file_initialization_enabled": TEXT}),
    "resource_governor_configuration": StateView("instance_state", 23, ["category"], {
        "is_enabled": FLAG, "max_outstanding_io_per_volume": INT, "ClassifierFunction": TEXT, "ClassifierFunctionDefinition": TEXT}),
    "resource_governor_resource_pool_affinity": StateView("instance_state", 24, ["category"], {"processor_group": INT, "scheduler_mask": INT}),
    "resource_governor_resource_pools": StateView("instance_state", 25, ["category"], {
        "min_cpu_percent": INT, "max_cpu_percent": INT, "min_memory_percent": INT, "max_memory_percent": INT,
        "cap_cpu_percent": INT, "min_iops_per_volume": INT, "max_iops_per_volume": INT}),
    "resource_governor_workload_groups": StateView("instance_state", 26, ["category"], {
        "importance": TEXT, "request_max_memory_grant_percent": INT, "request_max_cpu_time_sec": INT,
        "request_memory_grant_timeout_sec": INT, "max_dop": INT, "group_max_requests": INT,
        "request_max_memory_grant_percent_numeric": TEXT}),
    "resource_governor_external_resource_pool_affinity": StateView("instance_state", 27, ["category"], {"processor_group": INT, "cpu_mask": INT}),
    "resource_governor_external_resource_pools": StateView("instance_state", 28, ["category"], {
        "max_cpu_percent": INT, "max_memory_percent": INT, "max_processes": INT, "version": INT}),
}
VIEWS.update(STATE_VIEWS)


@view("log_shipping_primary_secondary_database_state")
def _(t, now):
    rows = select.current_rows(t[_LS]).filter("query = 22")
    return rows.select("group_a", "group_b", "group_c", "ts").distinct()


@view("instance_suspect_pages")
def _(t, now):
    wide = StateView("instance_state", 22, ["category"], {"event_type": TEXT, "error_count": INT, "last_update_date": TEXT})(t, now)
    part = c.split_category("category")
    return wide.withColumns({"database": part["head"], "file_id": part["middle"], "page_id": part["tail"]})


@view("agent_alerts")
def _(t, now):
    """Every wanted alert, and whether it is there."""
    found = StateView("instance_state", 10, ["category"], {"message_id": INT, "severity": INT})(t, now)
    found = found.select(F.col("category").alias("alert_name"), "message_id", "severity").withColumn("_there", F.lit(True))
    wanted = t["seed_agent_alerts"].join(found, ["message_id", "severity"], "left")
    return wanted.select("description", "message_id", "severity", "alert_name", F.col("_there").isNotNull().cast("int").alias("alert_exists"))


# The configurations that are checked.
CHECKED_CONFIGURATIONS = (1517, 1538, 1539, 1544, 1546, 1562, 1576, 1579, 1581, 1584, 1585, 1589)


@view("instance_configurations")
def _(t, now):
    """Values in use against the bounds for the product version; state 0 warns, 1 is fine."""
    found = StateView("instance_state", 4, ["category"], {"name": TEXT, "value_in_use": INT})(t, now)
    found = found.select(F.col("category").cast("int").alias("configuration_id"), "name", F.col("value_in_use").alias("value"))
    version = select.current_rows(t["instance_state"]).filter("query = 3")
    at = lambda key: version.select(F.max(F.when(F.col("key") == key, F.col("value").try_cast("int")))).scalar()
    bounds = t["seed_configurations"].filter((F.col("product_major") == at("ProductMajorVersion")) & (F.col("product_minor") == at("ProductMinorVersion")))
    rows = bounds.filter(F.col("configuration_id").isin(*CHECKED_CONFIGURATIONS)).join(found, "configuration_id")
    outside = F.coalesce((F.col("value") < F.col("minimum")) | (F.col("value") > F.col("maximum")), F.lit(False))
    return rows.select("configuration_id", "name", "value", (~outside).cast("int").alias("state"))


# What the hardware report calls its keys, and its codes.
HARDWARE_LABELS = {
    "cores_per_socket": "Cores per socket", "cpu_count": "CPU count", "max_workers_count": "Max workers count",
    "numa_node_count": "NUMA node count", "physical_memory_kb": "Physical memory MB", "ProcessorNameString": "Processor",
    "scheduler_count": "Scheduler count", "socket_count": "Socket count", "sql_memory_model": "SQL memory model",
    "SQL Server and OS Version Info": "SQL Server and OS Version Info", "sqlserver_start_time": "SQL server start time",
    "virtual_machine_type": "Virtual machine type"}
MEMORY_MODELS = {"1": "CONVENTIONAL", "2": "LOCK_PAGES", "3": "LARGE_PAGES"}
MACHINE_TYPES = {"0": "NONE", "1": "HYPERVISOR", "2": "OTHER"}


def _hardware(rows: DataFrame, value: str = "value") -> DataFrame:
    """The label of each key, and its value as the report shows it."""
    v = F.col(value)
    shown = (F.when(F.col("key") == "physical_memory_kb", F.floor(v.try_cast("bigint") / 1024).cast("string"))
             .when(F.col("key") == "sql_memory_model", c.decode(v, MEMORY_MODELS))
             .when(F.col("key") == "virtual_machine_type", c.decode(v, MACHINE_TYPES))
             .when(F.col("key") == "sqlserver_start_time", F.date_format(v.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
             .otherwise(v))
    return rows.withColumns({"label": c.decode(F.col("key"), HARDWARE_LABELS), f"{value}_text": shown})


@view("instance_hardware")
def _(t, now):
    rows = select.current_rows(t["instance_state"]).filter("query IN (17, 20)")
    return _hardware(rows.select("category", "key", "value", "valid_from"))


@view("trace_flags")
def _(t, now):
    rows = select.current_rows(t["instance_state"]).filter("query = 5").select(F.col("key").alias("flag"), "value", "ts")
    return joins.null_safe_join(rows, t["seed_trace_flags"], "flag", "left")


@view("instance_extended_events")
def _(t, now):
    rows = select.current_rows(t["instance_state"]).filter("query = 30")
    return rows.select("category", "key", "value", "ts")


@view("instance_sql_agent_properties")
def _(t, now):
    return select.current_rows(t["instance_state"]).filter("query = 29").select("category", "key", "value", "ts")


@view("database_scoped_configuration")
def _(t, now):
    rows = select.current_rows(t["database_state"]).filter("query = 60")
    return model.attach_keys(rows.select(F.col("key").alias("configuration")).distinct(), [model.KeySpec("configuration_key", ["configuration"])])


@view("database_scoped_configurations")
def _(t, now):
    rows = select.current_rows(t["database_state"]).filter("query = 60").withColumnRenamed("key", "configuration")
    # A value observed again within one poll keeps its newest row only.
    rows = chunked.newest_per_group(rows, ["database", "configuration"], ["valid_from", "value"])
    out = joins.null_safe_join(rows, t["seed_scoped_defaults"], "configuration", "left")
    differs = ~c.same_text("value", "default_value")
    return keyed(out.withColumn("is_default_text", c.yes_no(~differs)), None, configuration_key=["configuration"])


# -- state histories --------------------------------------------------------

def _history(t, now, table, entity, query, keys=None, ignore_empty=False):
    rows = t[table].filter(F.col("query").isin(query))
    return state.state_history(rows, entity, only_keys=keys, ignore_empty=ignore_empty)


# Hardware and log shipping keys with a history.
HARDWARE_KEYS = ("cores_per_socket", "cpu_count", "max_workers_count", "numa_node_count", "physical_memory_kb", "scheduler_count",
                 "socket_count", "sql_memory_model", "sqlserver_start_time", "virtual_machine_type")
SHIPPING_KEYS = (
    "backup_compression", "backup_destination_directory", "backup_directory", "backup_retention_period", "backup_share",
    "backup_source_directory", "backup_threshold", "block_size", "buffer_count", "disconnect_users", "file_retention_period",
    "history_retention_period", "max_transfer_size", "monitor_server", "monitor_server_security_mode", "primary_database",
    "primary_server", "restore_all", "restore_delay", "restore_mode", "restore_threshold", "threshold_alert",
    "threshold_alert_enabled", "user_specified_monitor")
_SHIPPED = ["query", "group_a", "group_b", "group_c"]

VIEWS["log_shipping_state_history"] = partial(_history, table=_LS, entity=_SHIPPED, query=[11, 12, 21, 31, 32], keys=SHIPPING_KEYS, ignore_empty=True)
VIEWS["instance_configurations_history"] = partial(_history, table="instance_state", entity=["category"], query=[4], keys=("value", "value_in_use"))
VIEWS["instance_hardware_history"] = lambda t, now: _hardware(_history(t, now, "instance_state", ["query", "category"], [17, 20], HARDWARE_KEYS))
VIEWS["trace_flags_history"] = partial(_history, table="instance_state", entity=["category"], query=[5])
VIEWS["instance_sql_agent_properties_history"] = partial(_history, table="instance_state", entity=["category"], query=[29])


@view("database_state_history")
def _(t, now):
    shown = [k for k in DATABASE_KEYS if k != "replica_id"]
    settings = _history(t, now, "database_state", ["database"], [31], shown)
    scoped = _history(t, now, "database_state", ["database"], [60])
    label = F.lit(None).cast("string")
    for k, kind in DATABASE_KEYS.items():
        if isinstance(kind, Mapping):
            label = F.when(F.col("key") == k, c.decode("value", kind)).otherwise(label)
        elif kind == FLAG:
            label = F.when(F.col("key") == k, c.yes_no(F.col("value").try_cast("boolean"))).otherwise(label)
    both = settings.unionByName(scoped)
    return keyed(both.withColumn("value_text", F.coalesce(label, F.col("value"))), None)


# -- log shipping -----------------------------------------------------------

def _shipping(t, now, agent):
    rows = t["log_shipping_events"].filter(F.col("agent") == agent)
    rows = aggregate.minutes_since_previous(rows, ["server", "database"], "last_ts_utc")
    rows = joins.with_scalar(rows, rows, {"_servers": F.count_distinct("server")})
    shown = F.when(F.col("_servers") == 1, F.col("database")).otherwise(F.concat_ws(" - ", "database", "server"))
    return keyed(rows.withColumn("database_server", shown).drop("_servers"), "last_ts", server_key=["server"])


# Which agent's events each view shows.
SHIPPING_AGENTS = {
    "log_shipping_monitor_primaries": "monitor backup", "log_shipping_monitor_secondary_copies": "monitor copy",
    "log_shipping_monitor_secondary_restores": "monitor restore", "log_shipping_primary_databases": "backup",
    "log_shipping_secondaries": "copy", "log_shipping_secondary_databases": "restore"}
VIEWS.update({n: partial(_shipping, agent=a) for n, a in SHIPPING_AGENTS.items()})


@view("log_shipping_monitor_secondaries")
def _(t, now):
    rows = t["log_shipping_events"].filter(F.col("agent").isin("monitor copy", "monitor restore"))
    return keyed(rows.select("server", "database").distinct(), None, server_key=["server"])


def _messages(t, now, source, bound=None):
    rows = t["messages"].filter(F.col("source") == source)
    rows = select.newest_n(rows, "event_ts", t.options[bound] if bound else 0, ["text"])
    return c.date_time_key(rows, "event_ts")


VIEWS["log_shipping_monitor_error_details"] = partial(_messages, source="log shipping error")
VIEWS["log_shipping_monitor_history_details"] = partial(_messages, source="log shipping history")
VIEWS["error_logs"] = partial(_messages, source="error log", bound="error_logs.rows")
VIEWS["log_messages"] = partial(_messages, source="log message", bound="log_messages.rows")


# -- gauges -----------------------------------------------------------------

@view("buffer_pool_usage")
def _(t, now):
    return keyed(t["gauges"].withColumn("size_mb", c.pages_to_mb("value")), "ts", name_key=["name"])


# The memory clerks shown.
MEMORY_CLERKS = ("MEMORYCLERK_SQLBUFFERPOOL", "MEMORYCLERK_SQLCONNECTIONPOOL", "OBJECTSTORE_LOCK_MANAGER")


@view("memory_clerks")
def _(t, now):
    shown = t["memory_clerks"].filter(select.name_filter("name", MEMORY_CLERKS))
    return keyed(shown.withColumn("size_mb", c.kb_to_mb("value")), "ts", name_key=["name"])


@view("plan_cache_usage")
def _(t, now):
    rows = t["plan_cache"].withColumns({"size_mb": c.bytes_to_mb("size_bytes"), "single_use_mb": c.bytes_to_mb("single_use_bytes")})
    return keyed(rows, "ts", cache_key=["cache_type", "object_type"])


# Scopes of a plan guide.
GUIDE_SCOPES = {1: "Object", 2: "SQL", 3: "Template"}


@view("plan_guides")
def _(t, now):
    rows = select.drop_sentinels(select.latest_snapshot(t["plan_guides"], "ts_utc"), {"database": "", "name": ""})
    rows = rows.withColumns({"scope_text": c.decode(F.col("scope_type").cast("int"), GUIDE_SCOPES),
                             "path": F.when(F.col("object").isNotNull(), c.quote_path("schema", "object"))})
    return keyed(with_yes_no(rows, "is_disabled"))


@view("triggers")
def _(t, now):
    rows = select.latest_snapshot(t["triggers"], "ts_utc").withColumn("path", c.quote_path("schema", "object"))
    return keyed(with_yes_no(rows, "is_disabled", "is_instead_of"))


# -- performance counters ---------------------------------------------------

@view("performance_statistics")
def _(t, now):
    return keyed(counters.cook_counters(t["performance_counters"]), "ts", counter_key=["object", "counter", "instance"])


@view("always_on_synchronization_lag")
def _(t, now):
    cooked = counters.cook_counters(t["performance_counters"]).filter(F.col("object").like("%:Database Replica"))
    delay, writes = F.col("counter") == "Transaction Delay", F.col("counter") == "Mirrored Write Transactions/sec"
    lag = counters.ratio_at_stamp(cooked, ["instance", "ts"], "ts_utc", "cooked_value", delay, writes, "lag_ms")
    return keyed(lag.withColumnRenamed("instance", "database"))


@view("memory_grants_pending")
def _(t, now):
    cooked = counters.cook_counters(t["performance_counters"]).filter(
        select.name_filter("counter", ["Memory Grants Pending"]) & select.name_filter("object", like=["%:Memory Manager"]))
    return select.newest_n(cooked.filter("cooked_value <> 0"), "ts_utc", t.options["memory_grants_pending.rows"], ["object", "instance"])


# -- sessions ---------------------------------------------------------------

@view("who_is_active")
def _(t, now):
    """``sort_order`` counts all sessions; the last collection, by the log, says how long ago one was seen."""
    worth = (F.col("sql_text") != "sp_server_diagnostics") & ~F.col("sql_text").like("WAITFOR DELAY %")
    collected = t["log"].filter(F.col("name") == "Who is active").select(F.max_by("ts", "ts_utc")).scalar()
    seen = counters.delta_from_first(t["session_samples"], ["session", "login_ts", "start_ts"], "collected",
                                     ["cpu", "reads", "writes"], keep=worth, hours=t.options["who_is_active.hours"] or None,
                                     last_seen=collected)
    rows = seen.withColumns({"elapsed_ms": c.datediff_boundary("millisecond", "start_ts", "collected"), "sql_text": t.text("sql_text")})
    order = [F.col("collected"), F.col("delta_reads"), F.col("session").desc()]
    rows = chunked.number_rows(rows, order, "sort_order")
    return select.newest_n(rows, "collected", t.options["who_is_active.rows"], ["session", "login_ts", "start_ts"])


# -- the warehouse about itself ---------------------------------------------

def _log(t, rows, name):
    """Rows after the newest log entry less the days; the newest entry is that of the whole log."""
    days = t.options[f"{name}.days"]
    if days:
        oldest = t["log"].select(F.timestamp_add("DAY", F.lit(-days), F.max("ts_utc"))).scalar()
        rows = rows.filter(F.col("ts_utc") > oldest)
    return select.newest_n(rows, "ts_utc", t.options[f"{name}.rows"], ["id"])


@view("log")
def _(t, now):
    return _log(t, t["log"], "log")


@view("log_non_debug_info")
def _(t, now):
    return _log(t, t["log"].filter("type NOT IN ('Debug', 'Info')"), "log_non_debug_info")


@view("configurations")
def _(t, now):
    return t["settings"].select("key", "value", "ts")


@view("processing")
def _(t, now):
    runs_ = t["run_log"].withColumn("duration_s", c.datediff_boundary("second", "started", "ended"))
    return c.date_time_key(runs_, "started")


@view("retentions")
def _(t, now):
    return t["retentions"].withColumn("description", F.concat_ws(" ", F.col("days").cast("string"), F.lit("days of"), "table"))


@view("schedules")
def _(t, now):
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    return with_yes_no(t["service_schedules"], "enabled", *days)


@view("lifecycle")
def _(t, now):
    return t["lifecycle"].withColumn("support", c.support_state("mainstream_end", "extended_end", _today(now)))


# -- dimensions -------------------------------------------------------------

@view("date")
def _(t, now):
    facts = [(df, "ts") for df in t.values() if "ts" in df.columns]
    return model.date_dimension(facts, _today(now))


@view("time")
def _(t, now):
    return model.time_dimension(next(iter(t.values())).sparkSession)


# Registered dimensions and the columns they are made of.
DIMENSIONS = {"database": _LEVELS[:1], "schema": _LEVELS[:2], "object": _LEVELS[:3], "index": _LEVELS,
              "filegroup": ("database", "filegroup"), "disk": ("mount",), "wait_type": ("wait_type",),
              "performance_counter": ("object", "counter", "instance"), "job": ("job",), "server": ("server",)}


def _dimension(t, now, name):
    wanted = DIMENSIONS[name]
    sources = [model.DimensionSource(df, {n: n for n in wanted}, F.col(wanted[-1]).isNotNull())
               for df in t.values() if set(wanted) <= set(df.columns)]
    return model.build_dimension(sources, f"{name}_key")


VIEWS.update({f"dimension_{n}": partial(_dimension, name=n) for n in DIMENSIONS})
