"""Event XML to tables (inventory J6 to J9).

Text is parsed once per row by ``from_xml`` with a stated schema, on the JVM.
Malformed text gives a null struct; ``malformed`` counts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import hash_key, strip_leading_lf
from .select import lookback, newest_n
from .reshape import union_distinct

_PROCESS = ("struct<_spid:string,_hostname:string,_clientapp:string,_loginname:string,"
            "_currentdbname:string,inputbuf:string,"
            "executionStack:struct<frame:array<string>>>")
BLOCKED_SCHEMA = (
    "_name string, data array<struct<_name:string,value:struct<`blocked-process-report`:"
    f"struct<`blocked-process`:struct<process:{_PROCESS}>,`blocking-process`:struct<process:{_PROCESS}>>>>>")
DEADLOCK_SCHEMA = (
    "_name string, data array<struct<_name:string,value:struct<deadlock:struct<`process-list`:"
    f"struct<process:array<{_PROCESS}>>>>>>")
RING_SCHEMA = ("_id int, SchedulerMonitorEvent struct<SystemHealth:"
               "struct<SystemIdle:int,ProcessUtilization:int,PageFaults:int>>")
_OPTIONS = {"attributePrefix": "_", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}


def _parsed(df: DataFrame, xml: str, schema: str) -> DataFrame:
    # Through explode, so that later filters and columns use the parsed value
    # instead of being pushed below it and parsing again.
    doc = F.from_xml(F.col(xml), schema, _OPTIONS)
    return df.select("*", F.explode(F.array(doc)).alias("_doc")).drop(xml)


def malformed(df: DataFrame, xml: str = "event_data") -> DataFrame:
    """How many texts are no XML document."""
    bad = F.from_xml(F.col(xml), "_corrupt_record string", {**_OPTIONS, "columnNameOfCorruptRecord": "_corrupt_record"})
    return df.agg(F.count_if(bad["_corrupt_record"].isNotNull()).alias("malformed"))


def ring_buffer(df: DataFrame, xml: str, ticks: str, ticks_now: Column, now: Column) -> DataFrame:
    """Health records to columns; the event time is ``now`` less the record's age in ticks (ms)."""
    doc = _parsed(df.filter(F.col(xml).contains("<SystemHealth>")), xml, RING_SCHEMA)
    health = F.col("_doc.SchedulerMonitorEvent.SystemHealth")
    age = ticks_now - F.col(ticks)
    return doc.select(
        F.col("_doc._id").alias("record_id"),
        F.timestamp_micros(F.unix_micros(now) - age * 1000).alias("event_ts"),
        health["ProcessUtilization"].alias("process_utilization"),
        health["SystemIdle"].alias("system_idle"), health["PageFaults"].alias("page_faults"))


def _participant(process: Column) -> list[Column]:
    return [process["_spid"].try_cast("int").alias("spid"), process["_hostname"].alias("host_name"),
            process["_clientapp"].alias("client_app"), process["_loginname"].alias("login_name"),
            process["_currentdbname"].alias("database")]


def blocked_processes(df: DataFrame, xml: str = "event_data", id_: str = "id", ts: str = "event_ts",
                      days: int | None = None, sets: int | None = None) -> DataFrame:
    """One row for the blocked and one for the blocking process of a report.

    Reports of a process blocking itself are left out.  ``days`` and ``sets``
    bound the reports, the newest first; None or 0 takes all.
    """
    df = lookback(df, ts, days, "day") if days else df
    doc = _parsed(df.filter(F.col(xml).contains("blocked_process_report")), xml, BLOCKED_SCHEMA)
    doc = doc.filter(F.col("_doc._name") == "blocked_process_report")
    data = F.get(F.filter(F.col("_doc.data"), lambda d: d["_name"] == "blocked_process"), F.lit(0))
    doc = doc.withColumn("_report", data["value"]["blocked-process-report"])
    blocked, blocking = (F.col("_report")[f"{side}-process"]["process"] for side in ("blocked", "blocking"))
    doc = doc.filter(blocked["_spid"] != blocking["_spid"])
    doc = newest_n(doc, ts, sets, [id_]) if sets else doc
    sides = F.array(F.struct(F.lit("Blocked").alias("type"), blocked.alias("p")),
                    F.struct(F.lit("Blocking").alias("type"), blocking.alias("p")))
    rows = doc.select(id_, ts, F.explode(sides).alias("_s")).filter(F.col("_s.p").isNotNull())
    p = F.col("_s.p")
    return rows.select(F.col(id_).alias("data_set"), ts, F.col("_s.type").alias("type"), *_participant(p),
                       strip_leading_lf(p["inputbuf"]).alias("statement"))


def deadlock_participants(df: DataFrame, xml: str = "event_data", id_: str = "id", ts: str = "event_ts",
                          days: int | None = None, sets: int | None = None) -> DataFrame:
    """One row per process of a deadlock, with its input buffer and first stack frame."""
    df = lookback(df, ts, days, "day") if days else df
    doc = _parsed(df.filter(F.col(xml).contains("xml_deadlock_report")), xml, DEADLOCK_SCHEMA)
    doc = doc.filter(F.col("_doc._name") == "xml_deadlock_report")
    doc = newest_n(doc, ts, sets, [id_]) if sets else doc
    processes = F.flatten(F.transform(F.col("_doc.data"), lambda d: d["value"]["deadlock"]["process-list"]["process"]))
    p = F.col("_p")
    return doc.select(id_, ts, F.explode(processes).alias("_p")).select(
        F.col(id_).alias("data_set"), ts, *_participant(p),
        strip_leading_lf(p["inputbuf"]).alias("statement"),
        strip_leading_lf(F.get(p["executionStack"]["frame"], F.lit(0))).alias("frame"))


def participants(blocked: DataFrame, deadlocks: DataFrame) -> DataFrame:
    """Who took part in either kind of event, once, with a key."""
    who = ["client_app", "host_name", "login_name"]
    return union_distinct(blocked.select(*who), deadlocks.select(*who)).withColumn("participant_key", hash_key(*who))
