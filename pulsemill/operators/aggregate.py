"""Aggregations and windows (inventory E and F).

Plain ``groupBy().agg()`` combines map-side and needs no helper; here are the
forms with a rule of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import datediff_boundary
from .chunked import CHUNK, names, number_rows, with_group, with_previous, with_row_number


def grouped(df: DataFrame, keys, **aggs: Column) -> DataFrame:
    """E1"""
    return df.groupBy(*names(keys)).agg(*[c.alias(n) for n, c in aggs.items()])


def union_grouped(a: DataFrame, b: DataFrame, keys, **aggs: Column) -> DataFrame:
    """Two sources (live and accumulated), grouped as one."""
    return grouped(a.unionByName(b, allowMissingColumns=True), keys, **aggs)


def by_type(df: DataFrame, keys, type_col: str, types: Mapping[str, object],
            agg=F.max, value: str = "value") -> DataFrame:
    """One column per wanted type, aggregated in one pass."""
    return grouped(df, keys, **{n: agg(F.when(F.col(type_col) == t, F.col(value))) for n, t in types.items()})


def share_of_total(df: DataFrame, value: str, within, name: str = "share",
                   spread_by: Sequence[str] | None = None) -> DataFrame:
    """A row's part of its group's sum; null where the sum is 0."""
    out = with_group(df, within, {"_total": F.sum(value)}, spread_by)
    part = F.try_divide(F.col(value).cast("double"), F.nullif(F.col("_total").cast("double"), F.lit(0.0)))
    return out.withColumn(name, part).drop("_total")


def collapse(df: DataFrame, keys, count: str = "files") -> DataFrame:
    """E5: one row per key, with how many rows it stands for."""
    return df.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias(count))


def distinct_count(df: DataFrame, col: str, name: str, keys=(), approximate: bool = False) -> DataFrame:
    """Exact by default; ``approximate`` uses a sketch."""
    count = F.approx_count_distinct(col) if approximate else F.count_distinct(col)
    return df.groupBy(*names(keys)).agg(count.alias(name))


def distinct_state(df: DataFrame, col: str, dims, approximate: bool = False) -> DataFrame:
    """What is needed to count different values of ``col`` by any of ``dims`` later, without the rows.

    Exact for integers: a bitmap (4 KB) for each combination of dims and each
    range of 32 768 values that occurs, so dense numbers (ids, keys in use)
    stay small.  ``approximate`` keeps one sketch a combination, for any type.
    Nulls don't count.  Keep it by day: a day's state is replaced or merged
    (``merge_distinct``) when its rows change, other days are not read.
    """
    rows = df.filter(F.col(col).isNotNull())
    if approximate:
        return rows.groupBy(*names(dims)).agg(F.hll_sketch_agg(col).alias("distinct_sketch"))
    value = F.col(col).cast("bigint")
    return (rows.groupBy(*names(dims), F.bitmap_bucket_number(value).alias("distinct_range"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("distinct_bits")))


def merge_distinct(state: DataFrame, dims, *more: DataFrame) -> DataFrame:
    """States brought together, or one state with fewer dims; values known to several count once."""
    for other in more:
        state = state.unionByName(other)
    if "distinct_sketch" in state.columns:
        return state.groupBy(*names(dims)).agg(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    return state.groupBy(*names(dims), "distinct_range").agg(F.bitmap_or_agg("distinct_bits").alias("distinct_bits"))


def distinct_from_state(state: DataFrame, name: str, dims=()) -> DataFrame:
    """How many different values there are by ``dims``, from the state alone.

    Groups without a value other than null have no row.
    """
    merged = merge_distinct(state, dims)
    if "distinct_sketch" in state.columns:
        return merged.select(*names(dims), F.hll_sketch_estimate("distinct_sketch").alias(name))
    return merged.groupBy(*names(dims)).agg(F.sum(F.bitmap_count("distinct_bits")).alias(name))


def text_of_parts(df: DataFrame, keys, part: str, order: Sequence[str], name: str,
                  sep: str = ", ") -> DataFrame:
    """A group's texts joined in order.

    The result is one string per group, so a group must be small by nature
    (the columns of an index, the lines of an order).
    """
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(part).alias("_text"))))
    return df.groupBy(*names(keys)).agg(
        F.array_join(F.transform(parts, lambda p: p["_text"]), sep).alias(name))


def hourly_rollup(df: DataFrame, keys, ts: str, value: str) -> DataFrame:
    """Count, sum, min and max per key, date and hour."""
    return df.groupBy(*names(keys), F.to_date(ts).alias("date"), F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("sum_s"),
        F.min(value).alias("min_s"), F.max(value).alias("max_s"))


def dense_rank_of_few(df: DataFrame, col: str, name: str) -> DataFrame:
    """dense rank over the distinct values of a low-cardinality column.

    The rank is taken on the distinct values only (scan modes, statuses);
    the rows get it by an equi join.
    """
    values = df.select(col).distinct()
    ranked = values.withColumn(name, F.dense_rank().over(Window.orderBy(col))).withColumnRenamed(col, "_v")
    return df.join(ranked, F.col(col).eqNullSafe(F.col("_v")), "left").drop("_v")


def dense_rank_of_many(df: DataFrame, col: str, name: str) -> DataFrame:
    """F4 for any number of values: they are numbered by ranges (``number_rows``), so no task ranks them all.

    Nulls come first, as in ``dense_rank_of_few``.
    """
    ranked = number_rows(df.select(F.col(col).alias("_v")).distinct(), "_v", name)
    return df.join(ranked, F.col(col).eqNullSafe(F.col("_v")), "left").drop("_v")


def duration_anomaly(runs: DataFrame, key, ts: str, duration_ms: str, n: int = 10, factor: float = 10,
                     floor_ms: int = 60_000, chunk: Column | None = None, block: int = 100_000) -> DataFrame:
    """is a run slower than ``factor`` x the mean of its previous ``n`` finished runs?

    Runs are numbered within the key and cut into blocks; a block also gets
    the ``n`` runs before it, so no key is windowed whole.
    """
    keys = names(key)
    finished = runs.filter(F.col(duration_ms).isNotNull())
    numbered = with_row_number(finished, keys, ts, "_no", chunk)
    own = F.floor((F.col("_no") - 1) / block)
    reaches_next = F.pmod(F.col("_no") - 1, F.lit(block)) >= block - n
    blocks = F.when(reaches_next, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn(CHUNK, F.explode(blocks))
    w = Window.partitionBy(*keys, CHUNK).orderBy("_no").rowsBetween(-n, -1)
    mean = F.avg(duration_ms).over(w)
    out = spread.withColumn("previous_mean_ms", mean).filter(F.col("_own") == F.col(CHUNK))
    slow = (F.col(duration_ms) > F.col("previous_mean_ms") * factor) & (F.col(duration_ms) > floor_ms)
    return out.withColumn("is_slow", F.coalesce(slow, F.lit(False))).drop("_no", "_own", CHUNK)


def minutes_since_previous(df: DataFrame, keys, ts: str, name: str = "minutes_since_previous",
                           chunk: Column | None = None) -> DataFrame:
    """F7"""
    out = with_previous(df, keys, ts, {"_prev": ts}, chunk)
    return out.withColumn(name, datediff_boundary("minute", "_prev", ts)).drop("_prev")
