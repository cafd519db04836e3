"""Queries over the given tables, each with equal SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import Tables, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows can be checked."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(build(Tables(spark, folder)))
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


def at(ts: str) -> str:
    """SQL: a timestamp as text."""
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def day(ts: str) -> str:
    """SQL: a date as text."""
    return f"strftime({ts}, '%Y-%m-%d')"


# SQL twins of the derived tables.
SNAPSHOTS = """
hourly AS (SELECT user_id % 20 AS entity, date_trunc('hour', ts) AS ts,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1, 2),
snap AS (SELECT entity, ts, CAST(date_trunc('week', ts) AS TIMESTAMP) AS epoch,
  CAST(sum(v) OVER w AS BIGINT) AS total, CAST(sum(n) OVER w AS BIGINT) AS hits,
  epoch_ms(ts) - epoch_ms(CAST(date_trunc('week', ts) AS TIMESTAMP)) AS sample_ms
  FROM hourly WINDOW w AS (PARTITION BY entity, date_trunc('week', ts) ORDER BY ts))"""
HISTORY = """
hist AS (SELECT user_id AS job, event_id AS seq,
  CASE WHEN event_type = 'purchase' THEN 0 ELSE event_id % 5 + 1 END AS step,
  CASE WHEN event_type = 'error' THEN 0 WHEN value > 150 THEN 3 ELSE 1 END AS status,
  ts AS started, CAST(floor(value) AS BIGINT) AS duration_s FROM events)"""
SCHEDULES = """
sched AS (SELECT o_orderkey AS job, o_orderkey % 7 AS schedule_id,
  CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 1 END AS freq_type,
  o_orderkey % 127 + 1 AS freq_interval,
  CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS subday_type,
  o_orderkey % 5 + 1 AS subday_interval, o_orderkey % 2 + 1 AS recurrence,
  CAST(o_orderdate AS DATE) AS start_date,
  CASE WHEN o_orderkey % 10 = 0 THEN DATE '1999-12-31' ELSE DATE '9999-12-31' END AS end_date,
  o_orderkey % 20 AS h0, o_orderkey % 20 + 3 AS h1,
  printf('%02d:15:00', o_orderkey % 20) AS t0, printf('%02d:30:00', o_orderkey % 20 + 3) AS t1 FROM orders)"""
ORDER_STATES = """
obs AS (SELECT o_custkey AS entity, o_orderdate AS ts, o_orderkey AS seq, 'status' AS key, o_orderstatus AS value FROM orders
  UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 'priority', o_orderpriority FROM orders)"""
STATE = ORDER_STATES + """,
daily AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY entity, key, ts ORDER BY seq DESC) = 1),
seen AS (SELECT *, lag(value) OVER (PARTITION BY entity, key ORDER BY ts) AS was FROM daily),
state AS (SELECT entity, key, value, ts AS valid_from,
  coalesce(lead(ts) OVER (PARTITION BY entity, key ORDER BY ts), TIMESTAMP '9999-12-31 23:59:59') AS valid_to
  FROM seen WHERE was IS NULL OR was <> value)"""

from . import columns, counters, facts, joins, model, runs, selection, sources, state, streams, views  # noqa: E402,F401
