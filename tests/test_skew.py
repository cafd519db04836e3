"""One key holds most rows: no task may get them all."""

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import chunked, counters, joins, select, state

ROWS = 60_000


@pytest.fixture
def shuffled_joins(spark):
    """No automatic broadcast, no run-time re-planning: the bare plan must spread."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    """Two thirds of the rows have key 0, one row a minute."""
    key = F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))
    return spark.range(ROWS).select(key.alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"),
                                    F.col("id").alias("n"), (F.col("id") % 2).alias("v"))


def largest_task(df, result: str) -> float:
    """The largest task's share of the rows; ``result`` is the operator's own column, so nothing is optimised away."""
    counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(result)).alias("h"))
    assert any(w in counts._jdf.queryExecution().optimizedPlan().toString() for w in ("Window", "Join"))
    return counts.agg(F.max("n") / F.sum("n")).first()[0]


def test_group_values(hot, shuffled_joins):
    out = chunked.with_group(hot, "k", {"m": F.max("n")}, ["seq"])
    assert "_spread" in [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line][0]
    assert largest_task(out, "m") < 0.2
    assert out.filter("k = 0").agg(F.min("m"), F.max("m"), F.count(F.lit(1))).first() == (ROWS - 1, ROWS - 1, ROWS * 2 // 3 + 1)


def test_deltas(hot, shuffled_joins):
    out = counters.counter_delta(hot, "k", "ts", ["n"], drop_zero=False, chunk=chunked.by_day("ts"))
    assert largest_task(out, "delta_n") < 0.25 and out.count() == ROWS
    # The 41 days of the hot key: gains of 1 and 2 in turn, across day ends too.
    assert out.filter("k = 0").groupBy("delta_n").count().filter("delta_n IS NOT NULL").count() == 2


def test_running_count_and_runs(hot, shuffled_joins):
    out = joins.interval_number(hot, "k", "seq", F.col("v") == 0, chunk=chunked.by_range("seq", 2000))
    assert largest_task(out, "interval_no") < 0.25
    assert out.filter("k = 0").agg(F.max("interval_no")).first()[0] == hot.filter("k = 0 AND v = 0").count() - (0 if (ROWS - 1) % 2 else 1)


def test_history(hot, shuffled_joins):
    out = state.scd2_build(hot, "k", "ts", "v", chunk=chunked.by_day("ts"))
    assert largest_task(out, "valid_to") < 0.25


def test_default_chunks(hot, shuffled_joins):
    """41 days in chunks of the default: no task gets the hot key whole."""
    assert largest_task(counters.counter_delta(hot, "k", "ts", ["n"], drop_zero=False), "delta_n") < 0.35
    assert largest_task(joins.asof_join(hot, hot.withColumnRenamed("n", "m"), "k", "ts", ["m"]), "m") < 0.35


def test_preferred_modes_of_one_hot_day(spark, shuffled_joins):
    """One entity and day, one stamp: rows are spread by all columns."""
    rows = spark.range(ROWS).select(F.lit(0).alias("k"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id").alias("n"),
                                    F.when(F.col("id") % 2 == 0, "A").alias("mode"))
    out = select.prefer_detail_per_day(rows, "k", "mode", ["A", "B"], "ts")
    assert out.count() == ROWS // 2 and largest_task(out, "n") < 0.25


def test_numbers_of_the_whole_table(hot, shuffled_joins):
    one_day = hot.withColumn("ts", F.timestamp_seconds(F.col("seq")))
    out = chunked.number_rows(one_day, ["ts"], "no")
    assert out.agg(F.min("no"), F.max("no"), F.count_distinct("no")).first() == (1, ROWS, ROWS)
    assert out.filter(F.col("no") != F.col("seq") + 1).count() == 0
    assert largest_task(chunked.number_rows(one_day, ["ts"], "no"), "no") < 0.25


def test_joins_with_inline_tables_leave_the_fact_where_it_is(spark):
    """A constant table has a few keys; a shuffle by them would gather the fact's rows in as few tasks."""
    from pulsemill.operators import model, reshape

    fact = spark.range(1000).select(F.pmod("id", F.lit(5)).cast("int").alias("k"), F.pmod("id", F.lit(2)).cast("string").alias("c"))
    dims = [(model.dimension_rows(spark, {1: "Urgent", 2: "High"}, "code", "label"), "k"),
            (model.junk_dimension(spark, "code string, label string", [("0", "Even")]), "c"),
            (reshape.inline_table(spark, "code string, label string", [("0", "Even")]), "c")]
    for dim, key in dims:
        for how, n in (("inner", 400 if key == "k" else 500), ("left", 1000)):
            out = fact.join(dim, F.col(key) == F.col("code"), how)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
            assert out.count() == n
    empty = reshape.inline_table(spark, "code string, label string", [])
    assert fact.join(empty, F.col("c") == F.col("code"), "left").count() == 1000
