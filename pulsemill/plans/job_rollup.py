"""Incremental hourly rollup of job runs: history to aggregate, step by step.

A step reads what is at or after each job's watermark, finds the finished runs,
marks lost history, and says what the rollup, the errors, the newest runs and
the watermark gain.  ``RollupStore`` keeps these gains by batch: a batch counts
once its commit is there, and one without is written anew, so a crash at any
point changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.aggregate import hourly_rollup
from ..operators.runs import failed_steps, runs_from_history
from ..operators.state import advance_watermark, keep_newest, missing_run_markers, rollup_merge
from ..session import scratch_dir
from ..sources.snapshots import conform, insert_if_absent, read_since

_RUN = "name string, job_status int, steps_status int, started timestamp, duration_s bigint"
_ROLLUP = ("name string, job_status int, steps_status int, date date, hour int, cnt bigint, sum_s bigint, "
           "min_s bigint, max_s bigint")
_KEYS = ["name", "job_status", "steps_status", "date", "hour"]


@dataclass(frozen=True)
class RollupTables:
    rollup: DataFrame      # hourly counts, sums, minima and maxima
    errors: DataFrame      # failed steps
    latest: DataFrame      # newest known run per job
    watermark: DataFrame   # (job, seq) of the newest run taken in

    @staticmethod
    def empty(spark: SparkSession) -> "RollupTables":
        make = lambda ddl: spark.createDataFrame([], ddl)
        return RollupTables(make(_ROLLUP), make("job string, seq bigint, step int, status int, started timestamp, "
                                                "duration_s bigint, job_duration_s bigint"),
                            make(_RUN), make("job string, seq bigint"))


def read_history(history: DataFrame, tables: RollupTables, open_from: int | None = None) -> DataFrame:
    """Rows at or after each job's watermark, and of jobs without one.

    ``open_from``: rows of jobs without a watermark begin here at the
    earliest; then a bound reaches the scan.  Sequence numbers are given in order, so a job that is new has
    none below the highest one read.
    """
    return read_since(history, tables.watermark, "job", "seq", unmarked_from=None if open_from is None else F.lit(open_from).cast("bigint"))


def gains(history: DataFrame, tables: RollupTables, wanted: Column | None = None,
          mark_missing: bool = True, open_from: int | None = None) -> RollupTables:
    """What one increment adds.  ``history`` has job, seq, step, status, started and duration_s.

    With ``open_from`` only history from the oldest watermark or from there on is read.  The watermark is a summary
    row, so the rows after it are whole runs and perhaps the start of one; if
    the row itself is gone, history was lost.  A last run that has no wanted
    step yet stays above the watermark and is judged again.
    """
    return gains_of(read_history(history, tables, open_from), tables, wanted, mark_missing)


def gains_of(since: DataFrame, tables: RollupTables, wanted: Column | None = None, mark_missing: bool = True) -> RollupTables:
    """The same from the rows that ``read_history`` gives."""
    marks = tables.watermark.select(F.col("job").alias("_job"), F.col("seq").alias("_mark"))
    fresh = since.join(marks, F.col("job").eqNullSafe(F.col("_job")) & (F.col("seq") <= F.col("_mark")), "left_anti")
    runs = runs_from_history(fresh, "job", "seq", "step", "status", "started", "duration_s", wanted)
    found = conform(runs.withColumnRenamed("job", "name"), _RUN)
    new = insert_if_absent(found, tables.latest, ["name", "started"])
    added = new
    if mark_missing:
        kept = since.filter("step = 0").select(F.col("job").alias("name"), "started")
        added = new.unionByName(conform(missing_run_markers(tables.latest, kept, tables.rollup), _RUN))
    delta = conform(hourly_rollup(added, ["name", "job_status", "steps_status"], "started", "duration_s"), _ROLLUP)
    # With the summary row at the watermark: it is the parent of the first steps after it.
    failed = failed_steps(since.select(*tables.errors.columns[:-1]), "job", "seq", "step", "status", "duration_s")
    return RollupTables(
        rollup=delta,
        errors=insert_if_absent(conform(failed, tables.errors.schema), tables.errors, ["job", "seq"]),
        latest=keep_newest(new, "name", "started"),
        watermark=advance_watermark(tables.watermark.limit(0), runs, "job", "seq"))


def merged(tables: RollupTables, gain: RollupTables) -> RollupTables:
    """Tables and what they gain, as one."""
    return RollupTables(
        rollup=rollup_merge(tables.rollup, gain.rollup, _KEYS),
        errors=tables.errors.unionByName(gain.errors),
        latest=keep_newest(tables.latest.unionByName(gain.latest), "name", "started"),
        watermark=advance_watermark(tables.watermark, gain.watermark, "job", "seq"))


def step(history: DataFrame, tables: RollupTables, wanted: Column | None = None,
         mark_missing: bool = True) -> RollupTables:
    """One increment: the tables after it."""
    return merged(tables, gains(history, tables, wanted, mark_missing))


class RollupStore:
    """The tables on disk, as gains by batch.

    Batch n holds what step n added; its commit is written last.  Readers see
    committed batches only, and the next step writes the batch after the last
    commit, over whatever a crash has left there.  Every ``COMPACT`` batches
    the tables are written whole, with a commit of their own, and reading
    begins there: a reader opens fewer than ``COMPACT`` batches.
    """

    PARTS = ("rollup", "errors", "latest", "watermark")
    COMPACT = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def _commits(self) -> DataFrame:
        return self._log("commits", "batch bigint, open_from bigint")

    def committed(self) -> int:
        """The number of committed batches."""
        return self._commits().agg(F.count(F.lit(1))).first()[0]

    def compacted(self) -> int:
        """The number of batches that the newest whole tables cover."""
        return self._log("compacted", "batches bigint").agg(F.coalesce(F.max("batches"), F.lit(0))).first()[0]

    def read(self) -> RollupTables:
        """The tables as of the last commit."""
        empty, n, whole = RollupTables.empty(self.spark), self.committed(), self.compacted()

        def tables(folders: list[str]) -> RollupTables:
            def part(name):
                return self.spark.read.schema(getattr(empty, name).schema).parquet(*[f"{self.root}/{name}/{f}" for f in folders])
            return RollupTables(**{name: part(name) for name in self.PARTS})

        base = tables([f"whole={whole}"]) if whole else empty
        return merged(base, tables([f"batch={i}" for i in range(whole, n)])) if n > whole else base

    def compact(self) -> None:
        """Write the tables whole; safe to run again after a crash."""
        n, now = self.committed(), self.read()
        if n == self.compacted():
            return
        for name in self.PARTS:
            getattr(now, name).write.mode("overwrite").parquet(f"{self.root}/{name}/whole={n}")
        self.spark.range(n, n + 1).select(F.col("id").alias("batches")).coalesce(1).write.mode("append").parquet(f"{self.root}/compacted")

    def advance(self, history: DataFrame, **options) -> None:
        """One step over ``history``; safe to run again after a crash."""
        n, before = self.committed(), self.read()
        last = self._commits().agg(F.max_by("open_from", "batch")).first()[0]
        # Read once: what a step adds is found by several readings of these rows.
        path, found = scratch_dir(self.spark, "since"), read_history(history, before, last)
        found.write.parquet(path)
        since = self.spark.read.schema(found.schema).parquet(path)
        gain = gains_of(since, before, **options)
        for name in self.PARTS:
            getattr(gain, name).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={n}")
        # Where the rows begin that the next step needs of jobs without a watermark.
        marks = self.spark.read.schema(before.watermark.schema).parquet(f"{self.root}/watermark/batch={n}").unionByName(before.watermark)
        marked = marks.select(F.col("job").alias("_job")).distinct()
        open_ = (since.join(marked.withColumn("_marked", F.lit(True)), F.col("job").eqNullSafe(F.col("_job")), "left")
                 .agg(F.min(F.when(F.col("_marked").isNull(), F.col("seq"))).alias("lo"), F.max("seq").alias("hi")))
        after = F.coalesce("lo", F.col("hi") + 1, F.lit(last).cast("bigint"))
        (open_.select(F.lit(n).cast("bigint").alias("batch"), F.greatest(after, F.lit(last).cast("bigint")).alias("open_from"))
         .coalesce(1).write.mode("append").parquet(f"{self.root}/commits"))
        if (n + 1) % self.COMPACT == 0:
            self.compact()
