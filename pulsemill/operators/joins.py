"""Joins (inventory D).

Equi, outer, semi and anti joins are left to Catalyst and AQE (which splits
skewed partitions of both join inputs); this module adds null-safe keys and
the forms the reference writes as correlated lookups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .chunked import by_range, names, with_group, with_last_known, with_previous, with_running_sum


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner",
                   suffix: str = "_right") -> DataFrame:
    """D2 (and D1, D3, D4, D5 by ``how``): join on keys where null equals null.

    Key columns appear once; other columns both sides have get ``suffix``.
    """
    keys = names(keys)
    on_right = {k: f"_k_{k}" for k in keys}
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    r = right.withColumnsRenamed({**on_right, **clash})
    joined = left.join(r, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(rk)) for k, rk in on_right.items()]), how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "full", "outer", "full_outer"):
        # A key is missing on the left only where the whole left row is; a
        # true null key is null on both sides, so coalesce is right.
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(rk)) for k, rk in on_right.items()})
    return joined.drop(*on_right.values())


def snapshot_stamps(df: DataFrame, ts: str, name: str = "previous_ts") -> DataFrame:
    """The distinct stamps, each with the one before it."""
    return with_previous(df.select(ts).distinct(), [], ts, {name: ts})


def previous_snapshot_join(df: DataFrame, keys, ts: str, values: Mapping[str, str],
                           how: str = "inner", chunk: Column | None = None) -> DataFrame:
    """Each row with its entity's row in the snapshot just before, table-wide.

    ``values`` maps new columns to columns of that earlier row.  The entity's
    own earlier row is the one wanted exactly if it carries the previous
    snapshot's stamp, so one lag replaces the self join.  ``how='left'``
    keeps rows without it, with nulls.  (entity, ts) must be unique.
    """
    prev = {f"_p_{n}": src for n, src in values.items()}
    lagged = with_previous(df, keys, ts, {**prev, "_p_ts": ts}, chunk)
    # The stamp list is small; AQE turns this into a broadcast by its
    # measured size, and keeps a shuffled join where it is not.
    stamped = lagged.join(snapshot_stamps(df, ts, "_prev_stamp"), ts, "left")
    hit = F.coalesce(F.col("_p_ts") == F.col("_prev_stamp"), F.lit(False))
    out = stamped if how == "left" else stamped.filter(hit)
    out = out.withColumns({n: F.when(hit, F.col(f"_p_{n}")) for n in values})
    return out.select(*df.columns, *values)


def asof_previous(df: DataFrame, keys, ts: str, values: Mapping[str, str],
                  chunk: Column | None = None) -> DataFrame:
    """D7, one table: each row with its own latest earlier row."""
    return with_previous(df, keys, ts, values, chunk)


def asof_join(left: DataFrame, right: DataFrame, keys, ts: str, values: Sequence[str],
              chunk: Column | None = None, prefix: str = "") -> DataFrame:
    """D7, two tables: each left row with the latest right row at or before it."""
    keys = names(keys)
    r = right.select(*keys, ts, F.struct(*values).alias("_right"), F.lit(0).alias("_side"))
    both = left.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    found = with_last_known(both, keys, [ts, "_side"], {"_found": F.col("_right")}, chunk)
    return found.filter("_side = 1").select(
        *left.columns, *[F.col("_found")[v].alias(prefix + v) for v in values])


def latest_parent(df: DataFrame, key, seq: str, is_parent: Column, values: Mapping[str, str],
                  chunk: Column | None = None) -> DataFrame:
    """Every row with columns of the newest parent row of smaller sequence."""
    parent = F.when(is_parent, F.struct(*dict.fromkeys(values.values())))
    out = with_last_known(df, key, seq, {"_parent": parent}, by_range(seq) if chunk is None else chunk)
    return out.select(*df.columns, *[F.col("_parent")[src].alias(n) for n, src in values.items()])


def first_row_per_group(df: DataFrame, keys, order, values: Mapping[str, str]) -> DataFrame:
    """Columns of the group's first row on each of its rows."""
    at = F.struct(*names(order))
    aggs = {n: F.min_by(src, at) for n, src in values.items()}
    return with_group(df, keys, aggs, names(order))


def interval_number(df: DataFrame, key, seq: str, is_boundary: Column, name: str = "interval_no",
                    chunk: Column | None = None) -> DataFrame:
    """Number the intervals (boundary k-1, boundary k] of each key from 0.

    A row's interval is the count of boundaries strictly before it; grouping
    by it replaces EXISTS or MIN over a range of sequences.
    """
    flag = is_boundary.cast("bigint")
    out = with_running_sum(df.withColumn("_is_boundary", flag), key, seq, {name: F.col("_is_boundary")},
                           by_range(seq) if chunk is None else chunk)
    return out.withColumn(name, F.col(name) - F.col("_is_boundary")).drop("_is_boundary")


def interval_agg(df: DataFrame, key, seq: str, is_boundary: Column, aggs: Mapping[str, Column],
                 chunk: Column | None = None) -> DataFrame:
    """One row per key and interval."""
    numbered = interval_number(df, key, seq, is_boundary, chunk=chunk)
    return numbered.groupBy(*names(key), "interval_no").agg(*[c.alias(n) for n, c in aggs.items()])


def group_flag(df: DataFrame, keys, test: Column, name: str, spread_by: Sequence[str] | None = None) -> DataFrame:
    """Does any row of the group pass the test?"""
    return with_group(df, keys, {name: F.max(F.coalesce(test, F.lit(False)))}, spread_by)


def with_number_series(df: DataFrame, start: Column, stop: Column, name: str = "n") -> DataFrame:
    """One row per number from ``start`` to ``stop``, both included; none if start > stop."""
    numbers = F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.explode(numbers).alias(name))


def unnest(df: DataFrame, parts: Column, name: str, keep_empty: bool = False) -> DataFrame:
    """One row per element; ``keep_empty`` keeps rows without any (outer)."""
    return df.select("*", (F.explode_outer if keep_empty else F.explode)(parts).alias(name))


def with_scalar(df: DataFrame, source: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Aggregates of another table on every row, as scalar subqueries."""
    return df.withColumns({n: source.select(c).scalar() for n, c in values.items()})


def wildcard_join(df: DataFrame, spec: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that a spec row asks for; null in the spec matches any value.

    One equi join per combination of null keys (2^k of them), each on the
    keys that the spec states, so there is no nested loop.  A row that fits
    several combinations is kept once.
    """
    out, hits = df, []
    for wild in range(2 ** len(keys)):
        stated = [k for i, k in enumerate(keys) if not wild >> i & 1]
        shape = [F.col(k).isNotNull() if k in stated else F.col(k).isNull() for k in keys]
        part = spec.filter(reduce(Column.__and__, shape))
        if not stated:
            hits.append(part.select(F.count(F.lit(1)) > 0).scalar())
            continue
        flag = f"_hit_{wild}"
        marks = part.select(*[F.upper(k).alias(f"_w_{k}") for k in stated]).distinct().withColumn(flag, F.lit(True))
        on = reduce(Column.__and__, [F.upper(F.col(k)) == F.col(f"_w_{k}") for k in stated])
        out = out.join(marks, on, "left").drop(*[f"_w_{k}" for k in stated])
        hits.append(F.col(flag).isNotNull())
    return out.filter(reduce(Column.__or__, hits)).select(*df.columns)


def group_bounds(df: DataFrame, keys, values: Mapping[str, Column], spread_by: Sequence[str] | None = None) -> DataFrame:
    """MIN/MAX (or any aggregate) of the group's rows on each of them."""
    return with_group(df, keys, values, spread_by)

