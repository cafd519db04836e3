"""Filters and the choice of snapshots (inventory C).

"Now" is always the table's own newest stamp, taken as a scalar subquery:
Spark computes it first and pushes the comparison into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .chunked import names, with_day_group, with_group

OPEN_END = "9999-12-31 23:59:59"


def newest_stamp(df: DataFrame, ts: str) -> Column:
    """The table's newest stamp as a scalar subquery."""
    return df.select(F.max(ts)).scalar()


def latest_snapshot(df: DataFrame, ts: str, stamps_of: DataFrame | None = None) -> DataFrame:
    """All rows of the newest snapshot; the stamp may come from another table."""
    return df.filter(F.col(ts) == newest_stamp(df if stamps_of is None else stamps_of, ts))


def last_snapshot_per_day(df: DataFrame, ts: str, local_ts: str | None = None) -> DataFrame:
    """All rows that carry the last stamp of their day."""
    day = F.to_date(local_ts or ts)
    return with_day_group(df, day, {"_last": F.max(ts)}).filter(F.col(ts) == F.col("_last")).drop("_last")


def lookback(df: DataFrame, ts: str, n: int, unit: str = "day", exact: bool = False, after: bool = False) -> DataFrame:
    """Rows near the newest stamp; with ``n`` = 0 all of them.

    By default fewer than ``n`` unit boundaries back; ``exact=True`` keeps
    ``ts >= newest - n units`` instead, with ``after`` also ``>``.  Either way
    it is one lower bound on ``ts``, worked out inside the subquery, so the
    scan skips what is older.
    """
    if n == 0:
        return df
    newest = F.max(ts)
    bound = (F.timestamp_add(unit.upper(), F.lit(-n), newest) if exact
             else F.timestamp_add(unit.upper(), F.lit(1 - n), F.date_trunc(unit, newest)))
    oldest = df.select(bound).scalar()
    return df.filter(F.col(ts) > oldest if after else F.col(ts) >= oldest)


def newest_n(df: DataFrame, ts: str, n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """C4: a top-n report; each task keeps n rows; 0 keeps all."""
    return df if n == 0 else df.orderBy(F.col(ts).desc(), *tie_break).limit(n)


def current_rows(state: DataFrame, valid_to: str = "valid_to") -> DataFrame:
    """C5"""
    return state.filter(F.col(valid_to) == F.lit(OPEN_END).cast("timestamp"))


def any_nonzero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with at least one measure that is known and not 0."""
    return df.filter(reduce(Column.__or__, [F.coalesce(F.col(c) != 0, F.lit(False)) for c in cols]))


def add_sentinel(df: DataFrame, marker: Mapping[str, object]) -> DataFrame:
    """C7, writer side: one heartbeat row that says "polled, nothing found".

    ``marker`` gives values for some columns; the others are null.
    """
    types = {f.name: f.dataType for f in df.schema}
    row = df.sparkSession.range(1).select(
        *[F.lit(marker.get(c)).cast(types[c]).alias(c) for c in df.columns])
    return df.unionByName(row)


def drop_sentinels(df: DataFrame, marker: Mapping[str, object]) -> DataFrame:
    """C7, reader side."""
    is_marker = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in marker.items()])
    return df.filter(~is_marker)


def top_n_by(df: DataFrame, measure: str, n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest; 0 keeps all."""
    return df if n == 0 else df.orderBy(F.col(measure).desc(), *tie_break).limit(n)


def name_filter(col: str, exact: Sequence[str] = (), like: Sequence[str] = ()) -> Column:
    """Allow-list of names and LIKE patterns, without regard to case."""
    name = F.upper(F.col(col))
    tests = [name.isin([e.upper() for e in exact])] if exact else []
    tests += [name.like(p.upper()) for p in like]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def _rank(mode: str, order: Sequence[str]) -> Column:
    """Position among the modes; the last listed one, others and null share the last rank."""
    position = F.array_position(F.lit(list(order)), F.col(mode))
    return F.when(position > 0, position).otherwise(F.lit(len(order))).cast("int")


def best_mode_rows(df: DataFrame, entity, mode: str, modes_best_first: Sequence[str], ts: str,
                   hours: int = 24) -> DataFrame:
    """Per entity, the best mode of the last ``hours`` and its newest stamp; ties stay."""
    recent = lookback(df, ts, hours, "hour", exact=True).withColumn("_rank", _rank(mode, modes_best_first))
    # A rank limit runs before the shuffle: each task sends its own best rows.
    w = Window.partitionBy(*names(entity)).orderBy("_rank", F.col(ts).desc())
    best = recent.withColumn("_best", F.rank().over(w)).filter("_best = 1")
    return best.drop("_rank", "_best")


def prefer_detail_per_day(df: DataFrame, entity, mode: str, modes_best_first: Sequence[str],
                          ts: str) -> DataFrame:
    """C11: per entity and day, the rows of the best mode seen that day.

    Rows of a hot group are spread by all their columns.
    """
    ranked = df.withColumns({"_day": F.to_date(ts), "_rank": _rank(mode, modes_best_first)})
    chosen = with_group(ranked, [*names(entity), "_day"], {"_best": F.min("_rank")})
    return chosen.filter(F.col("_rank") == F.col("_best")).drop("_day", "_rank", "_best")
