"""Measures over a star (inventory L).

A measure is a grouped aggregate.  Dates a measure refers to (latest, past)
are scalar subqueries, so a comparison of two days is one pass over the fact
that reads those days only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import safe_ratio
from .chunked import names, with_group


def measure(df: DataFrame, by, **aggs: Column) -> DataFrame:
    """L1/L2: additive measures by any dimension; units are arithmetic on the column."""
    return df.groupBy(*names(by)).agg(*[c.alias(n) for n, c in aggs.items()])


def ratio_of(num: Column, den: Column, scale: int | None = None) -> Column:
    """L3: blank if either is blank or the denominator is 0."""
    return safe_ratio(num, den, scale)


def share_over(df: DataFrame, by, removed, value: str, name: str = "share") -> DataFrame:
    """L4: each group's part of the total over the ``removed`` dimensions.

    The fact is reduced to one row per group first; totals are taken on that.
    """
    by, removed = names(by), names(removed)
    summed = df.groupBy(*by).agg(F.sum(value).alias("value"))
    outer = [c for c in by if c not in removed]
    out = (with_group(summed, outer, {"_total": F.sum("value")}) if outer
           else summed.withColumn("_total", summed.select(F.sum("value")).scalar()))
    return out.withColumn(name, safe_ratio("value", "_total")).drop("_total")


def _days(df: DataFrame, date: str) -> DataFrame:
    """One row: the distinct days in order.  A DATE has 3.7 million values at most, so the list is bounded."""
    return df.select(F.col(date).alias("_day")).distinct().agg(F.sort_array(F.collect_list("_day")).alias("_days"))


def _chosen(edge: str, choice: Column | None) -> Column:
    return F.lit(False) if choice is None else F.coalesce(F.col(edge) == choice, F.lit(False))


def _with_latest(days: DataFrame, bounds, chosen) -> DataFrame:
    last = F.size("_days") - 1
    edges = days.select(
        "_days", F.get("_days", F.lit(0)).alias("_oldest"), F.get("_days", F.lit(1)).alias("_after"),
        F.get("_days", last).alias("_newest"), F.get("_days", last - 1).alias("_before"))
    lo, hi = (F.col("_oldest"), F.col("_newest")) if bounds is None else bounds
    edges = edges.select("*", lo.alias("_lo"), hi.alias("_hi"))
    low = F.when((F.col("_lo") < F.col("_oldest")) | _chosen("_lo", chosen[0]), F.col("_oldest")).otherwise(F.col("_after"))
    high = F.when((F.col("_hi") > F.col("_newest")) | _chosen("_hi", chosen[1]), F.col("_newest")).otherwise(F.col("_before"))
    return edges.select("_days", F.when(high >= low, high).alias("latest"))


def _with_past(known: DataFrame, days: int, first_bound, chosen_first) -> DataFrame:
    bound = F.get("_days", F.lit(0)) if first_bound is None else first_bound
    known = known.select("_days", "latest", bound.alias("_bound"))
    floor = F.when(_chosen("_bound", chosen_first), F.col("_bound")).otherwise(F.date_add("_bound", 1))
    known = known.select("_days", "latest", floor.alias("_floor"), F.date_sub("latest", days).alias("_from"))
    found = F.get(F.filter("_days", lambda d: (d >= F.col("_from")) & (d >= F.col("_floor"))), F.lit(0))
    return known.select("latest", F.when(found.isNotNull(), F.least(found, F.col("latest"))).alias("past"))


def latest_date(df: DataFrame, date: str, *, bounds: tuple[Column, Column] | None = None,
                chosen: tuple[Column | None, Column | None] = (None, None)) -> Column:
    """The newest day to show, as a scalar: one aggregate of the fact's days.

    ``df`` is the fact as filtered by the viewer, ``bounds`` the first and
    last day there is data for at all.  Such an edge day is usually partial:
    it is trimmed to the next day inward, unless the viewer ``chose`` it.
    Null if nothing is left.
    """
    return _with_latest(_days(df, date), bounds, chosen).select("latest").scalar()


def past_date(df: DataFrame, date: str, latest: Column, days: int, *, first_bound: Column | None = None,
              chosen_first: Column | None = None) -> Column:
    """The first day with data at or after ``latest - days``, at most ``latest``.

    The very first day is skipped unless chosen, because it is partial.
    """
    known = _days(df, date).withColumn("latest", latest)
    return _with_past(known, days, first_bound, chosen_first).select("past").scalar()


def period_days(df: DataFrame, date: str, days: int, *, bounds: tuple[Column, Column] | None = None,
                chosen: tuple[Column | None, Column | None] = (None, None)) -> DataFrame:
    """L5 and L6 together: one row (latest, past), from one aggregate of the fact's days."""
    known = _with_latest(_days(df, date), bounds, chosen)
    return _with_past(known, days, None if bounds is None else bounds[0], chosen[0])


def period_ratio(df: DataFrame, by, date: str, value: Column, period: DataFrame) -> DataFrame:
    """(current - past) / past per group, one pass over the two days.

    ``period`` is one row (latest, past).  Its two days meet the fact in a
    broadcast equi join, and its past day bounds the scan.
    """
    sides = period.select(F.inline(F.array(F.struct(F.lit("current").alias("_side"), F.col("latest").alias("_day")),
                                           F.struct(F.lit("past").alias("_side"), F.col("past").alias("_day")))))
    near = df.filter(F.col(date) >= period.select(F.coalesce("past", "latest")).scalar())
    two = near.join(F.broadcast(sides), F.col(date) == F.col("_day"))
    on = lambda side: F.sum(F.when(F.col("_side") == side, value))
    out = two.groupBy(*names(by)).agg(on("current").alias("current_value"), on("past").alias("past_value"))
    return out.withColumn("ratio", safe_ratio(F.col("current_value") - F.col("past_value"), "past_value"))


def semi_additive(df: DataFrame, by, stamp, value: str, agg=F.max, name: str = "value") -> DataFrame:
    """Summed per stamp, then max, min or avg over the stamps."""
    by = names(by)
    per_stamp = df.groupBy(*by, *names(stamp)).agg(F.sum(value).alias("_sum"))
    return per_stamp.groupBy(*by).agg(agg("_sum").alias(name))


def at_last_stamp(df: DataFrame, by, ts: str, value: str, name: str = "value",
                  all_rows: DataFrame | None = None) -> DataFrame:
    """The sum at the last stamp of the last day.

    ``all_rows`` is the fact without the filters that must not move the stamp.
    """
    stamp = (df if all_rows is None else all_rows).select(F.max(ts)).scalar()
    return df.filter(F.col(ts) == stamp).groupBy(*names(by)).agg(F.sum(value).alias(name))


def success_rate(df: DataFrame, by, status: str, success: Sequence[str], counted: Sequence[str],
                 weight: str | None = None, name: str = "success_rate") -> DataFrame:
    """Successes per counted outcome; blank if there are none, 0 without a success."""
    n = F.lit(1) if weight is None else F.col(weight)
    total = F.sum(F.when(F.col(status).isin(list(counted)), n))
    good = F.sum(F.when(F.col(status).isin(list(success)), n))
    out = df.groupBy(*names(by)).agg(total.alias("_all"), good.alias("_good"))
    return out.withColumn(name, safe_ratio(F.coalesce("_good", F.lit(0)), "_all")).drop("_all", "_good")


def filtered_sum(test: Column, value: Column) -> Column:
    """A measure over the rows that pass a test."""
    return F.sum(F.when(test, value))
