"""The flagship: snapshots -> deltas -> keys -> star join -> daily measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import date_time_key
from ..operators.counters import counter_delta
from ..operators.measures import measure
from ..operators.model import KeySpec, Relation, attach_keys, date_dimension, star_join, time_dimension
from .tables import Tables, plain


def gains_by_day(snapshots: DataFrame, spark: SparkSession) -> DataFrame:
    deltas = counter_delta(snapshots, "entity", "ts", ["total", "hits"], epoch="epoch", max_gap=12)
    fact = attach_keys(date_time_key(deltas, "ts"), [KeySpec("entity_key", ["entity"])])
    dates = date_dimension([(snapshots, "ts")], F.lit("2024-02-01").cast("date")).select("date", "week_name", "is_weekend")
    times = time_dimension(spark).select("time_key", "hour")
    star = star_join(fact, [Relation("date", dates, "date", "date"), Relation("time", times, "time_key", "time_key")])
    return measure(star, ["entity", "date", "date_week_name", "date_is_weekend"],
                   total=F.sum("delta_total"), hits=F.sum("delta_hits"),
                   office_hits=F.sum(F.when(F.col("time_hour").between(8, 17), F.col("delta_hits"))))


def daily_gains(spark: SparkSession, folder: str) -> DataFrame:
    return plain(gains_by_day(Tables(spark, folder).snapshots, spark))
