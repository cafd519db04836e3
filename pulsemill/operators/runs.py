"""Run histories and schedules (inventory J1 to J5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import at_least_one, decode, packed_datetime, unpack_date, unpack_seconds
from ..functions.text import FREQ_DAILY, FREQ_WEEKLY, schedule_text
from .chunked import by_range, names, with_next
from .joins import interval_number, latest_parent
from .reshape import pivot_slots

# Run status codes and their labels.
RUN_STATUS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled", 4: "In progress", -1: "Missing data"}
FAILED, SUCCEEDED, IN_PROGRESS, MISSING = 0, 1, 4, -1
# Report keys of job outcomes, in report order.
OUTCOMES = {0: "Succeeded", 1: "Ended with errors", 2: "Failed", 3: "Retry", 4: "Canceled", 5: "In progress",
            99: "Missing data"}


def runs_from_history(hist: DataFrame, job: str, seq: str, step: str, status: str,
                      started: str, duration: str, wanted: Column | None = None,
                      chunk: Column | None = None, width: int = 1_000_000) -> DataFrame:
    """One row per run of a job.

    A summary row (step 0) ends a run; it owns the rows after the previous
    summary.  A run counts if a wanted step lies between the summaries before
    and after it.  ``steps_status`` is the least status other than success
    among its rows, or success.  A run of 0 s counts as 1 s.

    Runs are numbered by a running count of summaries, so no range join; the
    sequence numbers of a job are distinct, so a chunk holds ``width`` rows
    at most.
    """
    chunk = by_range(seq, width) if chunk is None else chunk
    is_summary = F.col(step) == 0
    numbered = interval_number(hist, job, seq, is_summary, "run_no", chunk)
    is_step = ~is_summary if wanted is None else ~is_summary & F.coalesce(wanted, F.lit(False))
    only = lambda c: F.max(F.when(is_summary, F.col(c)))
    runs = numbered.groupBy(job, "run_no").agg(
        only(seq).alias("seq"), only(status).alias("job_status"), only(started).alias("started"),
        only(duration).alias("duration_s"),
        F.min(F.when(F.col(status) != SUCCEEDED, F.col(status))).alias("_worst"),
        F.max(is_step).alias("_has_step"))
    runs = with_next(runs, job, "run_no", {"_next_has": "_has_step"}, by_range("run_no", width))
    return (runs.filter(F.col("seq").isNotNull())
            .filter(F.col("_has_step") | F.coalesce(F.col("_next_has"), F.lit(False)))
            .select(job, "seq", "job_status", F.coalesce("_worst", F.lit(SUCCEEDED)).alias("steps_status"),
                    "started", at_least_one("duration_s").alias("duration_s")))


def run_status_text(job_status: Column, steps_status: Column) -> Column:
    """A successful run with a failed step 'Ended with errors'."""
    ended = (job_status == SUCCEEDED) & (steps_status == FAILED)
    return F.when(ended, OUTCOMES[1]).otherwise(decode(job_status, RUN_STATUS))


def outcome_key(job_status: Column, steps_status: Column) -> Column:
    """J2 as the key of the outcome dimension; null for an unknown status."""
    text = run_status_text(job_status, steps_status)
    keys = F.create_map(*[F.lit(x) for key, label in OUTCOMES.items() for x in (label, key)])
    return F.try_element_at(keys, text).cast("bigint")


def failed_steps(hist: DataFrame, job: str, seq: str, step: str, status: str, duration: str,
                 chunk: Column | None = None) -> DataFrame:
    """Steps neither succeeded nor in progress, with how long the job's run before took.

    A step without an earlier run is left out.
    """
    known = latest_parent(hist, job, seq, F.col(step) == 0, {"job_duration_s": duration, "_parent_seq": seq}, chunk)
    bad = (F.col(step) != 0) & ~F.col(status).isin(SUCCEEDED, IN_PROGRESS)
    return known.filter(bad & F.col("_parent_seq").isNotNull()).drop("_parent_seq")


def expand_schedule(schedules: DataFrame, today: Column) -> DataFrame:
    """Daily and weekly schedules still active at ``today``, one row per hour slot.

    At most 24 rows per schedule; slots follow from the first and last hour
    and, for hourly recurrence, the step between them.
    """
    first = F.floor(unpack_seconds("start_time") / 3600).cast("int")
    last = F.floor(unpack_seconds("end_time") / 3600).cast("int")
    kind = F.col("subday_type")
    step = F.when(kind == 8, F.nullif(F.col("subday_interval"), F.lit(0))).otherwise(F.lit(1)).cast("int")
    end = F.when(kind == 1, first).otherwise(last)
    usable = kind.isin(1, 2, 4, 8) & (first <= end) & (step > 0)
    slots = F.when(usable, F.sequence(first, end, F.when(usable, step).otherwise(F.lit(1))))
    active = schedules.filter(F.col("freq_type").isin(FREQ_DAILY, FREQ_WEEKLY)
                              & (today <= unpack_date("end_date")))
    return active.withColumns(schedule_text()).withColumn("hour_slot", F.explode(slots)).filter("hour_slot <= 23")


def schedule_grid(schedules: DataFrame, today: Column, ids=("job", "schedule_id")) -> DataFrame:
    """The slots of a schedule side by side, h00 to h23."""
    slots = expand_schedule(schedules, today)
    group = [*names(ids), "when_text", "detail_text", "active_text"]
    return pivot_slots(slots, group, "hour_slot", range(24), "day_text")


def not_scheduled(schedules: DataFrame, schedule_id: str = "schedule_id") -> DataFrame:
    """Jobs without a schedule."""
    return schedules.filter(F.col(schedule_id).isNull())


def decode_history(hist: DataFrame, date: str = "run_date", time: str = "run_time",
                   duration: str = "run_duration") -> DataFrame:
    """B9 on a job history: packed integers to ``started`` and ``duration_s``."""
    return hist.withColumns({"started": packed_datetime(date, time), "duration_s": unpack_seconds(duration)})
