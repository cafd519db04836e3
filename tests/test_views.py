"""Every preset runs on its canonical tables; some are checked by value."""

import pytest
from helpers import frame, rows, ts
from pyspark.sql import functions as F, types as T

from pulsemill.plans.views import VIEWS, build
from pulsemill.sources.schemas import SHAPES

END = "9999-12-31 23:59:59"


@pytest.fixture(scope="module")
def empty(spark):
    return {n: spark.createDataFrame([], T.StructType.fromDDL(ddl)) for n, ddl in SHAPES.items()}


@pytest.fixture(scope="module")
def now(spark):
    return F.lit("2024-01-10").cast("timestamp")


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_view_is_well_typed(spark, empty, now, name):
    df = build(name, empty, now)
    assert len(df.columns) == len(set(df.columns))
    df._jdf.queryExecution().executedPlan()  # optimises and plans


def view(empty, now, name, **tables):
    return build(name, {**empty, **tables}, now)


def test_backup_age(spark, empty, now):
    state = frame(spark, "query int, database string, key string, value string, valid_to string, ts_utc timestamp, ts timestamp",
                  [(31, "a", "recovery_model", "1", END, ts(10), ts(10)), (31, "b", "recovery_model", "3", END, ts(0), ts(0))])
    state = state.withColumn("valid_to", F.col("valid_to").cast("timestamp"))
    b = frame(spark, SHAPES["backups"], [
        ("a", ts(5), ts(5), "D", None, None, False, False, None, ts(5), ts(5)), ("a", ts(20), ts(20), "L", None, None, False, False, None, ts(20), ts(20)),
        ("b", ts(48), ts(48), "D", None, None, False, False, None, ts(48), ts(48)), ("b", ts(99), ts(99), "D", None, None, True, False, None, ts(99), ts(99))])
    got = view(empty, now, "backup_age", database_state=state, backups=b)
    # a's full backup is older than its recovery model; b needs no log backup.
    assert rows(got, "database", "recovery_model", "latest_full", "full_age_hours", "latest_log", "log_age_hours")[1] == ("b", "Simple", ts(48), 168, None, None)
    a = rows(got, "database", "latest_full", "latest_log", "log_age_hours")[0]
    assert a == ("a", None, ts(20), 196)


def test_database_state(spark, empty, now):
    rows_ = [(31, "a", k, v, ts(0), END, ts(0), ts(0)) for k, v in
             (("state", "0"), ("recovery_model", "9"), ("is_read_only", "1"), ("compatibility_level", "150"), ("other", "x"))]
    schema = "query int, database string, key string, value string, valid_from timestamp, valid_to string, ts_utc timestamp, ts timestamp"
    df = frame(spark, schema, rows_).withColumn("valid_to", F.col("valid_to").cast("timestamp"))
    got = view(empty, now, "database_state", database_state=df).first()
    assert (got.state, got.recovery_model, got.is_read_only_text, got.is_encrypted_text, got.compatibility_level) == ("Online", "?:9", "Yes", "N.A.", 150)


def test_index_not_used(spark, empty, now):
    u = frame(spark, SHAPES["index_usage"], [
        ("d", "s", "o", i, n, 0, 0, 0, None, 2, True, ts(-9), t, t) for t, add in ((ts(0), 0), (ts(4), 1)) for i, n in (("used", 5 + add), ("idle", 5), (None, 1 + add))])
    assert rows(view(empty, now, "index_not_used", index_usage=u), "index") == [("idle",)]
    assert rows(view(empty, now, "index_usage", index_usage=u), "index", "delta_seeks") == [("used", 1), (None, 1)]


def test_wait_statistics(spark, empty, now):
    w = frame(spark, SHAPES["wait_counters"], [("W", 10, 1, 1, ts(-9), ts(0), ts(1)), ("W", 16, 1, 2, ts(-9), ts(1), ts(2))])
    got = view(empty, now, "wait_statistics", wait_counters=w)
    assert rows(got, "wait_type", "delta_sum_wait_ms", "date", "time_key") == [("W", 6, ts(0).date(), 7200)]


def test_partition_ranges_and_order(spark, empty, now):
    p = frame(spark, SHAPES["partitioned_indexes"], [
        ("d", "s", "o", "i", "g", n, "c", b, False, 1, ts(0), ts(0)) for n, b in ((1, "10"), (2, "20"), (3, None))])
    got = view(empty, now, "partitioned_indexes", partitioned_indexes=p)
    assert rows(got, "partition", "partition_range", "sort_order") == [
        (1, "c > Infinity and c <= 10", 1), (2, "c > 10 and c <= 20", 2), (3, "c > 20 and c <= Infinity", 3)]


def test_database_dimension_is_built_from_all_facts(spark, empty, now):
    c1 = frame(spark, SHAPES["cpu_per_database"], [("A", 1, ts(0), ts(0)), ("b", 1, ts(0), ts(0))])
    c2 = frame(spark, SHAPES["vlf_sizes"], [("a", 1, 1, 1.0, 1.0, ts(0), ts(0)), ("c", 1, 1, 1.0, 1.0, ts(0), ts(0))])
    got = view(empty, now, "dimension_database", cpu_per_database=c1, vlf_sizes=c2)
    assert rows(got, "database") == [("A",), ("b",), ("c",)]


def test_job_outcomes(spark, empty, now):
    r = frame(spark, SHAPES["hourly_rollup"], [("j", js, ss, ts(0).date(), 2, 1, 1, 1, 1) for js, ss in ((1, 1), (1, 0), (0, 0), (-1, -1), (7, 1))])
    assert rows(view(empty, now, "agent_jobs_performance", hourly_rollup=r), "outcome_key") == [(0,), (1,), (2,), (99,), (None,)]
    assert view(empty, now, "agent_job_status").count() == 7


def test_bounds_of_reports_are_options(spark, empty, now):
    log = frame(spark, SHAPES["log"], [(i, "n", "Error" if i % 2 else "Info", "t", ts(-10 * i), ts(-10 * i)) for i in range(40)])
    day = rows(view(empty, now, "log", log=log), "id")
    assert day == [(i,) for i in range(3)]  # after the newest less a day
    tables = {**empty, "log": log}
    assert build("log", tables, now, {"log.days": 0}).count() == 40
    assert rows(build("log", tables, now, {"log.days": 0, "log.rows": 2}), "id") == [(0,), (1,)]
    assert rows(build("log_non_debug_info", tables, now), "id") == [(i,) for i in range(1, 17, 2)]
    with pytest.raises(ValueError):
        build("log", tables, now, {"log.hours": 1})


def test_text_length_is_an_option(spark, empty, now):
    s = frame(spark, SHAPES["statements"], [])
    assert build("query_statements", {**empty, "statements": s}, now, {"text.length": 0}).columns == view(empty, now, "query_statements").columns


def test_modes_are_chosen_for_an_object(spark, empty, now):
    """Two indexes of one object, scanned in different modes the same day, and one without a mode."""
    scan = lambda index, mode, hour: ("d", "s", "o", index, 1, mode, 1.0, 1, 1, ts(hour), ts(hour))
    p = frame(spark, SHAPES["index_physical"], [scan("a", "DETAILED", 1), scan("b", "LIMITED", 2), scan("c", None, 3)])
    assert rows(view(empty, now, "index_physical", index_physical=p), "index") == [("a",)]
    assert rows(view(empty, now, "index_physical_detailed", index_physical=p), "index") == [("a",)]
    none = p.filter("index <> 'a'")
    assert rows(view(empty, now, "index_physical_detailed", index_physical=none), "index") == [("b",), ("c",)]
