"""The incremental rollup, in any number of steps, equals one pass."""

import pytest
from helpers import frame, rows, ts
from pyspark.sql import functions as F

from pulsemill.operators.aggregate import hourly_rollup
from pulsemill.operators.runs import failed_steps, runs_from_history
from pulsemill.plans.job_rollup import RollupStore, RollupTables, gains, step
from pulsemill.plans.tables import Tables


def stored(tables, path):
    out = {}
    for n in ("rollup", "errors", "latest", "watermark"):
        getattr(tables, n).write.parquet(f"{path}/{n}")
        out[n] = getattr(tables, n).sparkSession.read.parquet(f"{path}/{n}")
    return RollupTables(**out)


@pytest.fixture(scope="module")
def history(spark):
    h = Tables(spark, "/root/testdata/sf0.001").history
    return h.withColumns({"job": (F.col("job") % 7).cast("string"), "status": F.col("status").cast("int")})


def test_steps_equal_one_pass(spark, history, tmp_path):
    done = RollupTables.empty(spark)
    for i, until in enumerate((300, 310, 700, 700, 10_000)):  # one step sees nothing new
        done = stored(step(history.filter(F.col("seq") < until), done), str(tmp_path / str(i)))
    runs = runs_from_history(history, "job", "seq", "step", "status", "started", "duration_s").withColumnRenamed("job", "name")
    whole = hourly_rollup(runs, ["name", "job_status", "steps_status"], "started", "duration_s")
    assert rows(done.rollup) == rows(whole.select(*done.rollup.columns))
    errors = failed_steps(history, "job", "seq", "step", "status", "duration_s")
    assert rows(done.errors, "job", "seq", "job_duration_s") == rows(errors, "job", "seq", "job_duration_s")


def test_lost_history_is_marked_once(spark, tmp_path):
    schema = "job string, seq bigint, step int, status int, started timestamp, duration_s bigint"
    first = frame(spark, schema, [("j", 1, 1, 1, ts(0), 3), ("j", 2, 0, 1, ts(0), 4)])
    later = frame(spark, schema, [("j", 8, 1, 1, ts(5), 3), ("j", 9, 0, 1, ts(5), 6)])
    done = stored(step(first, RollupTables.empty(spark)), str(tmp_path / "a"))
    done = stored(step(later, done), str(tmp_path / "b"))
    assert rows(done.rollup, "job_status", "hour", "cnt", "sum_s") == [(-1, 0, 1, 0), (1, 0, 1, 4), (1, 5, 1, 6)]
    again = step(later, done)
    assert rows(again.rollup, "job_status", "hour", "cnt") == [(-1, 0, 1), (1, 0, 1), (1, 5, 1)]


@pytest.mark.parametrize("written", range(5))
def test_a_crash_at_any_point_changes_nothing(spark, tmp_path, written):
    """``written`` parts of the second batch are there when it breaks off."""
    schema = "job string, seq bigint, step int, status int, started timestamp, duration_s bigint"
    rows_ = [("j", 2 * i + k, 1 - k, 1 if i != 2 else 0, ts(i), 3 + i) for i in range(5) for k in (0, 1)]
    store = RollupStore(spark, str(tmp_path))
    store.advance(frame(spark, schema, rows_[:4]))
    whole = frame(spark, schema, rows_)
    for name in RollupStore.PARTS[:written]:
        getattr(gains(whole, store.read()), name).write.parquet(f"{store.root}/{name}/batch=1")
    store.advance(whole)
    store.advance(whole)  # and a step without news adds nothing
    got, want = store.read(), step(whole, step(frame(spark, schema, rows_[:4]), RollupTables.empty(spark)))
    for name in RollupStore.PARTS:
        assert rows(getattr(got, name)) == rows(getattr(want, name))
    assert rows(got.rollup, "cnt", "sum_s") == [(1, n) for n in (3, 4, 5, 6, 7)]


def test_history_below_the_watermark_is_left_out(spark, tmp_path):
    schema = "job string, seq bigint, step int, status int, started timestamp, duration_s bigint"
    rows_ = [("j", 2 * i + k, 1 - k, 1, ts(i), 3 + i) for i in range(5) for k in (0, 1)]
    store = RollupStore(spark, str(tmp_path))
    store.advance(frame(spark, schema, rows_[:6]))
    before = store.read()
    # Only the watermark's own row and what follows it is needed.
    full, cut = (gains(frame(spark, schema, r), before) for r in (rows_, rows_[5:]))
    for name in RollupStore.PARTS:
        assert rows(getattr(full, name)) == rows(getattr(cut, name))


def test_whole_tables_and_open_jobs_over_many_steps(spark, history, tmp_path, monkeypatch):
    monkeypatch.setattr(RollupStore, "COMPACT", 2)
    store = RollupStore(spark, str(tmp_path / "s"))
    # A job that is not done for long, and one that comes late.
    slow = frame(spark, "job string, seq bigint, step int, status int, started timestamp, duration_s bigint",
                 [("slow", 50, 1, 1, ts(1), 3), ("slow", 640, 0, 1, ts(1), 9), ("new", 801, 1, 1, ts(2), 1), ("new", 802, 0, 1, ts(2), 5)])
    every = history.select(*slow.columns).unionByName(slow)
    for until in (300, 600, 650, 900, 10_000):
        store.advance(every.filter(F.col("seq") < until))
    assert store.committed() == 5 and store.compacted() == 4
    runs = runs_from_history(every, "job", "seq", "step", "status", "started", "duration_s").withColumnRenamed("job", "name")
    whole = hourly_rollup(runs, ["name", "job_status", "steps_status"], "started", "duration_s")
    got = store.read()
    assert rows(got.rollup) == rows(whole.select(*got.rollup.columns))
    opened = [r.open_from for r in store._commits().orderBy("batch").collect()]
    assert opened[0] == 50 and opened[1] == 50 and opened[2] > 600


def test_the_bound_of_a_step_reaches_the_scan(spark, history, tmp_path):
    path = str(tmp_path / "h")
    history.write.parquet(path)
    store = RollupStore(spark, str(tmp_path / "s"))
    df = spark.read.parquet(path)
    store.advance(df.filter("seq < 500"))
    from pulsemill.plans.job_rollup import read_history
    since = read_history(df, store.read(), store._commits().first().open_from)
    plan = since._jdf.queryExecution().explainString(since._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x and "seq" in x]
    assert pushed and all("GreaterThanOrEqual(seq" in x for x in pushed)
