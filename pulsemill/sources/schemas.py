"""Canonical input shapes (Spark DDL).  Columns a file lacks are read as nulls."""

_STAMPS = "ts_utc timestamp, ts timestamp"
_INDEX = "database string, schema string, object string, index string"
_VALID = f"valid_from timestamp, valid_to timestamp, {_STAMPS}"

SHAPES = {
    "wait_counters": "wait_type string, sum_wait_ms bigint, sum_signal_ms bigint, tasks bigint, "
                     f"restart_ts timestamp, {_STAMPS}",
    "file_io": "database string, file string, type smallint, sample_ms bigint, reads bigint, bytes_read bigint, "
               f"stall_read_ms bigint, writes bigint, bytes_written bigint, stall_write_ms bigint, {_STAMPS}",
    "index_usage": "database string, schema string, object string, index string, seeks bigint, scans bigint, "
                   "lookups bigint, updates bigint, last_seek timestamp, index_type smallint, is_unique boolean, "
                   f"restart_ts timestamp, {_STAMPS}",
    "query_counters": "database string, query_hash binary, plan binary, created timestamp, executions bigint, "
                      "worker_ms bigint, logical_reads bigint, elapsed_ms bigint, rows bigint, "
                      f"restart_ts timestamp, {_STAMPS}",
    "missing_indexes": "database string, schema string, object string, query_hash string, equality string, "
                       "inequality string, included string, seeks bigint, scans bigint, avg_cost double, "
                       f"avg_impact double, restart_ts timestamp, {_STAMPS}",
    "performance_counters": "object string, counter string, instance string, value bigint, type int, "
                            f"restart_ts timestamp, {_STAMPS}",
    "gauges": f"name string, value bigint, {_STAMPS}",
    "memory_clerks": f"name string, value bigint, {_STAMPS}",
    "file_sizes": "database string, logical string, physical string, type smallint, mount string, "
                  f"filegroup string, current int, used int, max int, growth int, {_STAMPS}",
    "state": "query int, `group` string, key string, value string, valid_from timestamp, valid_to timestamp, "
             f"{_STAMPS}",
    "backups": "database string, start timestamp, finish timestamp, type string, size decimal(20,0), "
               f"compressed decimal(20,0), copy_only boolean, damaged boolean, device string, {_STAMPS}",
    "job_history": "job string, sequence bigint, step_id int, step_name string, run_date int, run_time int, "
                   "run_duration int, status int, message string",
    "hourly_rollup": "name string, job_status int, steps_status int, date date, hour int, cnt bigint, "
                     "sum_s bigint, min_s bigint, max_s bigint",
    "job_schedules": "job string, schedule_id int, enabled boolean, freq_type int, freq_interval int, "
                     "subday_type int, subday_interval int, recurrence int, start_date int, end_date int, "
                     "start_time int, end_time int, ts_utc timestamp",
    "xml_events": "id bigint, event_ts timestamp, file string, offset bigint, event_data string",
    "session_samples": "session int, login_ts timestamp, start_ts timestamp, collected timestamp, cpu bigint, "
                       "reads bigint, writes bigint, sql_text string",
    "index_scans": "object string, mode string, fragmentation double, pages bigint, ts_utc timestamp",
    "run_log": "id bigint, task string, name string, version string, started timestamp, ended timestamp",
    "cpu_per_database": f"database string, cpu_ms bigint, {_STAMPS}",
    "cpu_utilization": "event_ts_utc timestamp, event_ts timestamp, process_utilization int, system_idle int, "
                       f"page_faults bigint, {_STAMPS}",
    "statistics_age": f"{_INDEX}, partition int, last_updated timestamp, rows bigint, rows_sampled bigint, steps int, "
                      f"modifications bigint, is_hypothetical boolean, {_STAMPS}",
    "allocation_units": f"{_INDEX}, filegroup string, partition int, unit_type smallint, total_pages bigint, "
                        f"used_pages bigint, data_pages bigint, {_STAMPS}",
    "disk_sizes": f"mount string, total_mb bigint, free_mb bigint, {_STAMPS}",
    "partitioned_indexes": f"{_INDEX}, filegroup string, partition int, partition_column string, boundary string, "
                           f"boundary_on_right boolean, rows bigint, {_STAMPS}",
    "table_sizes": f"{_INDEX}, partition int, rows bigint, reserved_kb bigint, data_kb bigint, index_kb bigint, "
                   f"unused_kb bigint, {_STAMPS}",
    "vlf_sizes": "database string, vlf_count int, active_vlf int, vlf_size_mb double, active_size_mb double, "
                 f"{_STAMPS}",
    "connections": f"protocol string, auth_scheme string, encrypt boolean, connections int, {_STAMPS}",
    "sessions": f"database string, host string, program string, login string, status string, sessions int, {_STAMPS}",
    "index_operational": f"{_INDEX}, leaf_inserts bigint, leaf_deletes bigint, leaf_updates bigint, range_scans bigint, "
                         "singleton_lookups bigint, lock_waits bigint, lock_wait_ms bigint, latch_waits bigint, "
                         f"latch_wait_ms bigint, restart_ts timestamp, {_STAMPS}",
    "index_physical": f"{_INDEX}, partition int, mode string, fragmentation double, pages bigint, rows bigint, {_STAMPS}",
    "index_state": f"{_INDEX}, index_type smallint, is_unique boolean, is_primary_key boolean, is_disabled boolean, "
                   f"has_filter boolean, key_columns string, included_columns string, {_STAMPS}",
    "maintenance_log": f"{_INDEX}, command_type string, command string, started timestamp, ended timestamp, "
                       "error_number int, error_message string",
    "log_shipping_events": "server string, database string, agent string, last_ts_utc timestamp, last_ts timestamp, "
                           f"file string, latency_min int, {_STAMPS}",
    "plan_cache": f"cache_type string, object_type string, plans bigint, size_bytes bigint, single_use_bytes bigint, {_STAMPS}",
    "plan_guides": f"database string, schema string, object string, name string, is_disabled boolean, scope_type smallint, query_text string, {_STAMPS}",
    "triggers": f"database string, schema string, object string, name string, is_disabled boolean, is_instead_of boolean, events string, {_STAMPS}",
    "statements": f"database string, query_hash binary, statement string, {_STAMPS}",
    "log": f"id bigint, name string, type string, text string, {_STAMPS}",
    "messages": f"source string, event_ts timestamp, text string, {_STAMPS}",
    "settings": f"key string, value string, {_STAMPS}",
    "service_schedules": "name string, task string, enabled boolean, delay_s int, from_time int, to_time int, "
                         f"monday boolean, tuesday boolean, wednesday boolean, thursday boolean, friday boolean, saturday boolean, sunday boolean, {_STAMPS}",
    "retentions": "table string, sequence int, time_column string, is_utc boolean, days int, filter string",
    "job_step_errors": "job string, step_id int, step_name string, status int, started timestamp, duration_s bigint, "
                       "job_duration_s bigint, message string",
    "database_state": f"query int, database string, key string, value string, {_VALID}",
    "always_on_state": f"query int, group_a string, group_b string, group_c string, key string, value string, {_VALID}",
    "log_shipping_state": f"query int, group_a string, group_b string, group_c string, key string, value string, {_VALID}",
    "instance_state": f"query int, category string, key string, value string, {_VALID}",
    "lifecycle": "product string, version string, mainstream_end date, extended_end date",
    "seed_scoped_defaults": "configuration string, default_value string",
    "seed_agent_alerts": "description string, message_id int, severity int",
    "seed_configurations": "configuration_id int, product_major int, product_minor int, minimum int, maximum int",
    "seed_trace_flags": "flag string, description string, url string",
}
