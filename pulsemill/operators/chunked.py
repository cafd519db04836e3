"""Ordered and grouped work that survives one key holding a third of all rows.

A plain ``Window.partitionBy(entity)`` puts a whole entity into one task.
Here an entity's rows are cut into chunks along the order column (a month, an
id range), each chunk is windowed on its own, and what must cross a chunk
boundary travels as one *seed row* per (entity, chunk):

1. each chunk is summarised by a partial aggregate (map-side combined),
2. the summaries, one row per (entity, chunk), are folded in order,
3. the folded state is unioned in front of the chunk's rows as a seed, and
   one shuffle on (entity, chunk) feeds the window; seeds are then dropped.

A chunk must be a non-decreasing function of the first order column.  Its
size is bounded by the data model: stamps of one entity are distinct, so a
month holds at most its polls (43 200 at one a minute); ids are distinct, so
an id range holds at most its width.  Coarser chunks mean fewer summaries,
finer ones smaller tasks; months suit polls, days suit event streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_dir

CHUNK, SEED = "_chunk", "_seed"
# A key above 1/HOT_SHARE of the rows is hot; so there are fewer than
# HOT_SHARE hot keys, whatever the data size.
HOT_SHARE = 10_000


def names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def by_day(ts: str) -> Column:
    return F.to_date(ts)


def by_month(ts: str) -> Column:
    return F.trunc(F.to_date(ts), "month")


def by_year(ts: str) -> Column:
    return F.trunc(F.to_date(ts), "year")


def by_range(col: str, width: int = 1_000_000) -> Column:
    return F.floor(F.col(col) / width)


def _position(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _seeded(df: DataFrame, keys: Sequence[str], chunk: Column, summaries: Mapping[str, Column],
            fold: str, forward: bool = True) -> DataFrame:
    work = df.withColumns({CHUNK: chunk, SEED: F.lit(False)})
    per_chunk = work.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in summaries.items()])
    along = Window.partitionBy(*keys).orderBy(F.col(CHUNK).asc() if forward else F.col(CHUNK).desc())
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    folds = {
        "neighbour": lambda n: F.lag(n).over(along),
        "last": lambda n: F.last(n, ignorenulls=True).over(earlier),
        "sum": lambda n: F.sum(n).over(earlier),
    }
    seeds = (per_chunk.withColumn("_chunk_no", F.row_number().over(along))
             .select(*keys, CHUNK, F.lit(True).alias(SEED), "_chunk_no",
                     *[folds[fold](n).alias(n) for n in summaries])
             .filter("_chunk_no > 1").drop("_chunk_no"))
    return work.unionByName(seeds, allowMissingColumns=True)


def _unseed(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(SEED)).drop(CHUNK, SEED)


def with_previous(df: DataFrame, keys, order, values: Mapping[str, str],
                  chunk: Column | None = None) -> DataFrame:
    """``values`` maps a new column to the column it lags by one row.

    All lags share one shuffle and one sort.  ``order`` must be total within
    a key; ``chunk`` defaults to the day of the first order column.
    """
    return _neighbour(df, names(keys), names(order), values, chunk, forward=True)


def with_next(df: DataFrame, keys, order, values: Mapping[str, str],
              chunk: Column | None = None) -> DataFrame:
    """as ``with_previous``, looking one row ahead."""
    return _neighbour(df, names(keys), names(order), values, chunk, forward=False)


def _neighbour(df, keys, order, values, chunk, forward):
    chunk = by_day(order[0]) if chunk is None else chunk
    pick = F.max_by if forward else F.min_by
    # A seed carries the neighbour's values in the rows' own columns, so no
    # copy is shuffled; it sorts by its mark, not by what it carries.
    seen = [c for c in dict.fromkeys(values.values()) if c not in keys]
    work = _seeded(df, keys, chunk, {c: pick(c, _position(order)) for c in seen}, "neighbour", forward)
    seed_side = F.col(SEED).desc() if forward else F.col(SEED).asc()
    w = Window.partitionBy(*keys, CHUNK).orderBy(seed_side, *order)
    look = F.lag if forward else F.lead
    return _unseed(work.withColumns({new: look(src).over(w) for new, src in values.items()}))


def with_last_known(df: DataFrame, keys, order, values: Mapping[str, Column],
                    chunk: Column | None = None) -> DataFrame:
    """The latest non-null value among strictly earlier rows of the key."""
    keys, order = names(keys), names(order)
    chunk = by_day(order[0]) if chunk is None else chunk
    held = {new: f"_held_{new}" for new in values}
    work = df.withColumns({held[new]: c for new, c in values.items()})
    at = _position(order)
    summaries = {h: F.max_by(h, F.when(F.col(h).isNotNull(), at)) for h in held.values()}
    work = _seeded(work, keys, chunk, summaries, "last")
    w = (Window.partitionBy(*keys, CHUNK).orderBy(F.col(SEED).desc(), *order)
         .rowsBetween(Window.unboundedPreceding, -1))
    out = work.withColumns({new: F.last(h, ignorenulls=True).over(w) for new, h in held.items()})
    return _unseed(out).drop(*held.values())


def with_running_sum(df: DataFrame, keys, order, values: Mapping[str, Column],
                     chunk: Column | None = None, descending: bool = False) -> DataFrame:
    """Running totals up to and including each row; integers stay exact.

    ``order`` holds names or sort Columns; with sort Columns give ``chunk``,
    and ``descending=True`` when the order runs against it.
    """
    keys = names(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    chunk = by_day(order[0]) if chunk is None else chunk
    work = df.withColumns(dict(values))
    work = _seeded(work, keys, chunk, {n: F.sum(n) for n in values}, "sum", forward=not descending)
    w = (Window.partitionBy(*keys, CHUNK).orderBy(F.col(SEED).desc(), *order)
         .rowsBetween(Window.unboundedPreceding, 0))
    return _unseed(work.withColumns({n: F.sum(n).over(w) for n in values}))


def with_row_number(df: DataFrame, keys, order, name: str = "row_no",
                    chunk: Column | None = None, descending: bool = False) -> DataFrame:
    """position within the key, or in the whole table with ``keys=[]``."""
    return with_running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, chunk, descending)


def number_rows(df: DataFrame, order, name: str = "row_no") -> DataFrame:
    """F3 over a whole table: 1, 2, ... along ``order``, which should be total.

    The rows are sorted in ranges and written to the shared scratch folder
    with their places, so that a second reading finds the same ranges.  A row's
    number is its place in its range plus the sizes of the ranges before; of
    these there are as many as the sort has tasks.
    """
    path = scratch_dir(df.sparkSession, "numbered")
    df.orderBy(*([order] if isinstance(order, (str, Column)) else order)).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path).withColumns({
        "_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", before.alias("_before"))
    numbered = placed.join(F.broadcast(ranges), "_range")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name))


def with_group(df: DataFrame, keys, aggs: Mapping[str, Column], spread_by: Sequence[str] | None = None,
               hot_share: int = HOT_SHARE) -> DataFrame:
    """A group's aggregates on every row of the group, whatever its size.

    Stands in for ``agg().over(partitionBy(keys))``.  Groups are reduced by a
    partial aggregate.  Hot groups, fewer than ``hot_share`` of them, come by
    broadcast, and their rows are spread over all tasks; the rest meet in a
    shuffled null-safe join.  ``spread_by`` names columns that tell rows of a
    group apart (an id, a stamp; by default all columns).  They are hashed,
    not drawn at random, so a lost task gives the same rows again.
    """
    keys = names(keys)
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in aggs.items()])
    total = df.select(F.count(F.lit(1))).scalar()
    renamed = {k: f"_r_{k}" for k in keys}
    hot = (per.filter(F.col("_n") * F.lit(hot_share) > total)
           .withColumnsRenamed({**renamed, **{n: f"_hot_{n}" for n in aggs}})
           .withColumnRenamed("_n", "_hot"))
    cold = (per.withColumnsRenamed({**renamed, **{n: f"_cold_{n}" for n in aggs}})
            # Always 0, but no constant: a constant would be folded out of the
            # join keys, and the spread rows would meet in one task again.
            .withColumn("_r_spread", F.least(F.col("_n"), F.lit(0).cast("bigint"))).drop("_n"))
    on = [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
    spread = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.xxhash64(*(spread_by or df.columns)).bitwiseOR(F.lit(1)))
    out = (df.join(F.broadcast(hot), reduce(Column.__and__, on), "left").drop(*renamed.values())
           .withColumn("_spread", spread.cast("bigint")))
    out = out.join(cold, reduce(Column.__and__, [*on, F.col("_spread") == F.col("_r_spread")]), "left")
    value = lambda n: F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{n}")).otherwise(F.col(f"_cold_{n}"))
    return out.select(*[F.col(c) for c in df.columns if c not in aggs],
                      *[value(n).alias(n) for n in aggs])


def with_day_group(df: DataFrame, day: Column, aggs: Mapping[str, Column]) -> DataFrame:
    """A calendar day's aggregates on every row of the day, without a shuffle.

    There are at most 3.7 million days in a DATE, so the broadcast is bounded.
    """
    per = (df.groupBy(day.alias("_day")).agg(*[c.alias(n) for n, c in aggs.items()]))
    return df.join(F.broadcast(per), day.eqNullSafe(F.col("_day")), "left").drop("_day")


def newest_per_group(df: DataFrame, keys, order, oldest: bool = False) -> DataFrame:
    """The newest row per key.

    Spark turns the ``= 1`` filter into a group limit ahead of the shuffle:
    each task sends one row per key, so a hot key is no burden.
    """
    along = [F.col(c).asc_nulls_last() if oldest else F.col(c).desc_nulls_last() for c in names(order)]
    w = Window.partitionBy(*names(keys)).orderBy(*along)
    return df.withColumn("_newest", F.row_number().over(w)).filter("_newest = 1").drop("_newest")
