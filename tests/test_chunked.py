"""Chunked windows equal plain windows for any chunk width, also on one hot key."""

import random

import pytest
from helpers import frame, rows, ts
from pyspark.sql import Window, functions as F

from pulsemill.operators import chunked as ch
from pulsemill.operators import joins
from pulsemill.operators.aggregate import duration_anomaly


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(7)
    out = []
    for i in range(600):
        key = None if r.random() < 0.1 else "hot" if r.random() < 0.7 else r.choice("abc")
        out.append((key, i * 7 + r.randrange(5), r.choice([None, *range(50)])))
    return frame(spark, "k string, seq bigint, v int", out).cache()


@pytest.mark.parametrize("width", [1, 10, 97, 100_000])
def test_neighbours(data, width):
    by, w = ch.by_range("seq", width), Window.partitionBy("k").orderBy("seq")
    got = ch.with_next(ch.with_previous(data, "k", "seq", {"p": "v", "ps": "seq"}, by), "k", "seq", {"n": "v"}, by)
    want = data.withColumns({"p": F.lag("v").over(w), "ps": F.lag("seq").over(w), "n": F.lead("v").over(w)})
    assert rows(got, "k", "seq", "v", "p", "ps", "n") == rows(want, "k", "seq", "v", "p", "ps", "n")


@pytest.mark.parametrize("width", [1, 10, 97, 100_000])
def test_last_known_and_running_sum(data, width):
    by, w = ch.by_range("seq", width), Window.partitionBy("k").orderBy("seq")
    got = ch.with_last_known(data, "k", "seq", {"l": F.when(F.col("v") > 30, F.struct("v", "seq"))}, by)
    got = ch.with_running_sum(got, "k", "seq", {"s": F.coalesce("v", F.lit(0)).cast("bigint")}, by)
    known = F.last(F.when(F.col("v") > 30, F.col("v")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = data.withColumns({"lv": known, "s": F.sum(F.coalesce("v", F.lit(0))).over(w)})
    assert rows(got.withColumn("lv", F.col("l.v")), "k", "seq", "lv", "s") == rows(want, "k", "seq", "lv", "s")


def test_global_row_number_descending(data):
    got = ch.with_row_number(data, [], [F.col("seq").desc()], "no", ch.by_range("seq", 50), descending=True)
    want = data.withColumn("no", F.row_number().over(Window.orderBy(F.desc("seq"))).cast("bigint"))
    assert rows(got, "seq", "no") == rows(want, "seq", "no")


@pytest.mark.parametrize("hot_share", [1, 2, 10, 10_000])
def test_group_values_with_and_without_hot_keys(data, hot_share):
    aggs = {"n": F.count(F.lit(1)), "m": F.max("v")}
    got = ch.with_group(data, "k", aggs, ["seq"], hot_share)
    w = Window.partitionBy("k")
    want = data.withColumns({"n": F.count(F.lit(1)).over(w), "m": F.max("v").over(w)})
    assert rows(got, "k", "seq", "v", "n", "m") == rows(want, "k", "seq", "v", "n", "m")


def test_group_values_over_several_null_keys(spark):
    df = frame(spark, "a string, b int, v int", [(None, None, 1), (None, None, 2), (None, 1, 3), ("x", None, 4)])
    for share in (1, 10_000):
        assert rows(ch.with_group(df, ["a", "b"], {"s": F.sum("v")}, hot_share=share), "v", "s") == [(1, 3), (2, 3), (3, 3), (4, 4)]


def test_day_groups_and_newest(spark):
    df = frame(spark, "k string, ts timestamp, v int", [("a", ts(1), 1), ("a", ts(30), 2), ("b", ts(2), 3), ("b", ts(2), 4)])
    got = ch.with_day_group(df, F.to_date("ts"), {"n": F.count(F.lit(1))})
    assert rows(got, "v", "n") == [(1, 3), (2, 1), (3, 3), (4, 3)]
    assert rows(ch.newest_per_group(df, "k", ["ts", "v"]), "v") == [(2,), (4,)]
    assert rows(ch.newest_per_group(df, "k", ["ts", "v"], oldest=True), "v") == [(1,), (3,)]


@pytest.mark.parametrize("block", [11, 25, 1000])
def test_rolling_mean_over_blocks(spark, block):
    df = spark.range(300).select(F.lit("k").alias("k"), "id", (F.col("id") * 37 % 101).alias("ms"))
    got = duration_anomaly(df, "k", "id", "ms", n=10, factor=1.5, floor_ms=20, chunk=ch.by_range("id", 40), block=block)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(-10, -1)
    want = df.withColumn("previous_mean_ms", F.avg("ms").over(w)).withColumn(
        "is_slow", F.coalesce((F.col("ms") > F.col("previous_mean_ms") * 1.5) & (F.col("ms") > 20), F.lit(False)))
    assert rows(got, "id", "previous_mean_ms", "is_slow") == rows(want, "id", "previous_mean_ms", "is_slow")


def test_asof_join_takes_rows_at_the_same_stamp(spark):
    left = frame(spark, "k string, ts timestamp, l int", [("a", ts(1), 1), ("a", ts(50), 2), (None, ts(3), 3), ("b", ts(3), 4)])
    right = frame(spark, "k string, ts timestamp, r int", [("a", ts(1), 10), ("a", ts(2), 20), (None, ts(2), 30), ("b", ts(4), 40)])
    assert rows(joins.asof_join(left, right, "k", "ts", ["r"]), "l", "r") == [(1, 10), (2, 20), (3, 30), (4, None)]


def test_wildcard_join(spark):
    df = frame(spark, "id int, o string, c string", [(1, "O1", "x"), (2, "o2", "y"), (3, "o3", "x"), (4, "o3", "z")])
    spec = frame(spark, "o string, c string", [("o1", None), (None, "Y"), ("o3", "x"), ("o1", "x")])
    assert rows(joins.wildcard_join(df, spec, ["o", "c"]), "id") == [(1,), (2,), (3,)]
    every = frame(spark, "o string, c string", [(None, None)])
    assert joins.wildcard_join(df, every, ["o", "c"]).count() == 4
