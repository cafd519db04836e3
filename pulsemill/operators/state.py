"""Stateful table maintenance (inventory H).

Functions return the table's new content; writing it is the caller's choice
(a new folder, or the touched partitions only).  Nothing here needs MERGE.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import datediff_boundary
from .chunked import by_year, names, newest_per_group, with_next, with_previous, with_running_sum
from .joins import null_safe_join
from .select import OPEN_END, current_rows


def _open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp")


# -- histories --------------------------------------------------------------

def scd2_merge(state: DataFrame, inventory: DataFrame, keys, value: str, now: Column,
               valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """H1: bring a history up to date with what is there at ``now``.

    Open rows whose key vanished or whose value changed are closed; new keys
    and values get an open row.  Keys and values compare null-safely, and a
    key occurs once in ``inventory``.  Only open rows meet the inventory.
    """
    keys = names(keys)
    is_open = F.col(valid_to) == _open_end()
    seen = inventory.select(*keys, F.col(value).alias("_value"), F.lit(True).alias("_seen"))
    met = null_safe_join(state.filter(is_open).withColumn("_known", F.lit(True)), seen, keys, "full")
    known, there = F.col("_known").isNotNull(), F.col("_seen").isNotNull()
    same = known & there & F.col(value).eqNullSafe(F.col("_value"))
    types = {f.name: f.dataType for f in state.schema}

    def row(own: Mapping[str, Column]) -> Column:
        return F.struct(*[own.get(c, F.col(c)).cast(types[c]).alias(c) for c in state.columns])

    kept = row({valid_to: F.when(same, F.col(valid_to)).otherwise(now)})
    blank = {c: F.lit(None) for c in state.columns if c not in keys}
    fresh = row({**blank, value: F.col("_value"), valid_from: now, valid_to: _open_end()})
    # A key gives up to two rows: the one it had and a new one.
    rows = met.select(F.inline(F.array_compact(F.array(F.when(known, kept), F.when(there & ~same, fresh)))))
    return state.filter(~is_open).unionByName(rows)


def scd2_build(observations: DataFrame, keys, ts: str, value: str, order: Sequence[str] = (),
               valid_from: str = "valid_from", valid_to: str = "valid_to",
               chunk: Column | None = None) -> DataFrame:
    """H2: the whole history in one pass over observations.

    The first sight of a value opens it, the next different one closes it.
    ``order`` breaks ties of ``ts`` within a key.
    """
    keys, along = names(keys), [ts, *order]
    marked = observations.select(*dict.fromkeys([*keys, *along, value])).withColumn("_any", F.lit(True))
    seen = with_previous(marked, keys, along, {"_was": value, "_had": "_any"}, chunk)
    changes = seen.filter(F.col("_had").isNull() | ~F.col(value).eqNullSafe(F.col("_was")))
    ended = with_next(changes.drop("_was", "_had", "_any"), keys, along, {"_until": ts}, chunk)
    return ended.select(*keys, value, F.col(ts).alias(valid_from),
                        F.coalesce(F.col("_until"), _open_end()).alias(valid_to))


def inventory_history(polls: DataFrame, keys, ts: str, value: str, opened: DataFrame | None = None,
                      last_poll: Column | None = None, valid_from: str = "valid_from", valid_to: str = "valid_to",
                      chunk: Column | None = None) -> DataFrame:
    """H1 over many full inventories at once: rows that share a stamp are one poll.

    A row opens when its key is new, was missing in the poll before, or has
    another value; it closes at the next poll that lacks it or differs.
    ``opened`` are the open rows as of ``last_poll``, the poll before the
    first of these.
    """
    keys = names(keys)
    rows = polls.select(*keys, value, F.col(ts).alias("_at"), F.col(ts).alias(valid_from))
    stamps = polls.select(F.col(ts).alias("_at")).distinct()
    if opened is not None:
        rows = rows.unionByName(opened.select(*keys, value, last_poll.alias("_at"), valid_from))
        stamps = stamps.unionByName(opened.select(last_poll.alias("_at")).filter(F.col("_at").isNotNull()).distinct()).distinct()
    # The list of polls is small; AQE broadcasts it by its measured size.
    stamps = with_next(with_previous(stamps, [], "_at", {"_poll_before": "_at"}), [], "_at", {"_poll_after": "_at"})
    placed = rows.join(stamps, "_at", "left").withColumn("_value", F.struct(value))
    seen = with_previous(placed, keys, "_at", {"_was": "_value", "_was_at": "_at"}, chunk)
    starts = F.coalesce((F.col("_was_at") != F.col("_poll_before")) | ~F.col("_value").eqNullSafe(F.col("_was")), F.lit(True))
    numbered = with_running_sum(seen, keys, "_at", {"_run": starts.cast("bigint")}, chunk)
    runs = numbered.groupBy(*keys, "_run").agg(F.max_by(value, "_at").alias(value), F.min_by(valid_from, "_at").alias(valid_from),
                                               F.max_by(F.struct("_poll_after"), "_at").alias("_end"))
    return runs.select(*keys, value, valid_from, F.coalesce(F.col("_end._poll_after"), _open_end()).alias(valid_to))


def state_history(state: DataFrame, entity, key: str = "key", value: str = "value",
                  only_keys: Sequence[str] | None = None, ignore_empty: bool = False,
                  valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """H3: changes of entities that still exist.

    ``newer_value`` is the value of the next newer row of the same entity and
    key; rows equal to it are no change and are dropped.  An open end shows
    as null.  ``ignore_empty`` also drops '' values that differ from the
    newer one (rows without a newer one stay).
    """
    entity = names(entity)
    rows = state if only_keys is None else state.filter(F.col(key).isin(list(only_keys)))
    present = current_rows(state, valid_to).select(*entity).distinct()
    rows = null_safe_join(rows, present, entity, "left_semi")
    out = with_next(rows, [*entity, key], valid_to, {"newer_value": value}, by_year(valid_to))
    differs = F.col(value) != F.col("newer_value")
    if ignore_empty:
        differs = (F.col(value) != "") & differs
    out = out.filter(F.coalesce(differs, F.lit(False)) | F.col("newer_value").isNull())
    return out.withColumn(valid_to, F.nullif(F.col(valid_to), _open_end()))


def state_as_of(state: DataFrame, ts: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """H4: rows valid at a moment (from included, to excluded)."""
    return state.filter((F.col(valid_from) <= ts) & (ts < F.col(valid_to)))


# -- rollups and watermarks -------------------------------------------------

def rollup_merge(rollup: DataFrame, delta: DataFrame, keys, count: str = "cnt", total: str = "sum_s",
                 low: str = "min_s", high: str = "max_s") -> DataFrame:
    """H5: add a delta rollup: counts and sums add up, min and max stretch."""
    both = rollup.unionByName(delta)
    return both.groupBy(*names(keys)).agg(F.sum(count).alias(count), F.sum(total).alias(total),
                                          F.min(low).alias(low), F.max(high).alias(high))


def advance_watermark(watermark: DataFrame, batch: DataFrame, entity, ts: str) -> DataFrame:
    """H6: the newest stamp per entity, of old and new; it never goes back."""
    entity = names(entity)
    both = watermark.select(*entity, ts).unionByName(batch.select(*entity, ts))
    return both.groupBy(*entity).agg(F.max(ts).alias(ts))


# -- keyed tables -----------------------------------------------------------

def upsert(target: DataFrame, source: DataFrame, keys, set_: Sequence[str] | None = None,
           mode: str = "always") -> DataFrame:
    """H7: insert unknown keys; known ones by ``mode``.

    'always' overwrites ``set_`` (default: all columns but the keys),
    'if_different' does so only where some value differs, 'insert_only'
    leaves known rows alone.  Keys are unique on both sides.
    """
    keys = names(keys)
    set_ = [c for c in target.columns if c not in keys] if set_ is None else list(set_)
    rest = [c for c in source.columns if c not in keys]
    src = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in rest], F.lit(True).alias("_src"))
    met = null_safe_join(target.withColumn("_tgt", F.lit(True)), src, keys, "full")
    is_new = F.col("_tgt").isNull()
    differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in set_ if c in rest], F.lit(False))
    touch = {"always": F.col("_src").isNotNull(), "insert_only": F.lit(False),
             "if_different": F.col("_src").isNotNull() & differs}[mode]

    def merged(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in rest:
            return F.col(c)
        takes = is_new | touch if c in set_ else is_new
        return F.when(takes, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)

    return met.select(*[merged(c) for c in target.columns])


def upsert_keep_previous(target: DataFrame, source: DataFrame, keys, value: str,
                         previous: str = "previous_value", changes: str = "changes") -> DataFrame:
    """H8: as H7, but a changed value moves to ``previous`` and counts up ``changes``."""
    keys = names(keys)
    src = source.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_src"))
    met = null_safe_join(target.withColumn("_tgt", F.lit(True)), src, keys, "full")
    is_new = F.col("_tgt").isNull()
    changed = ~is_new & F.col("_src").isNotNull() & ~F.col(value).eqNullSafe(F.col("_new"))
    return met.select(
        *keys,
        F.when(is_new | changed, F.col("_new")).otherwise(F.col(value)).alias(value),
        F.when(changed, F.col(value)).otherwise(F.col(previous)).alias(previous),
        F.when(is_new, F.lit(0)).when(changed, F.col(changes) + 1).otherwise(F.col(changes))
        .cast("bigint").alias(changes))


def delete_orphans(dictionary: DataFrame, facts: DataFrame, keys) -> DataFrame:
    """H9: dictionary rows that some fact still names."""
    keys = names(keys)
    return null_safe_join(dictionary, facts.select(*keys).distinct(), keys, "left_semi")


def apply_retention(df: DataFrame, ts: str, rules: Sequence[tuple[int, Column | None]]) -> DataFrame:
    """Keep rows within ``days`` of the table's newest stamp, rule by rule.

    Each rule is (days, filter); it drops rows that match the filter (all, if
    None) and are older.  No rule drops the newest row, so the rules need not
    run one after the other.
    """
    keep = F.lit(True)
    for days, only in rules:
        old = F.col(ts) < df.select(F.timestamp_add("DAY", F.lit(-days), F.max(ts))).scalar()
        drop = old if only is None else old & F.coalesce(only, F.lit(False))
        keep = keep & ~drop
    return df.filter(keep)


def keep_newest(df: DataFrame, keys, ts: str) -> DataFrame:
    """The newest processed row per entity."""
    return newest_per_group(df, keys, ts)


def pair_begin_end(log: DataFrame, id_cols, ts: str, is_begin: Column, is_end: Column) -> DataFrame:
    """Begin and end records to one row with the duration; open runs keep a null end."""
    runs = log.groupBy(*names(id_cols)).agg(F.min(F.when(is_begin, F.col(ts))).alias("started"),
                                            F.max(F.when(is_end, F.col(ts))).alias("ended"))
    return (runs.filter(F.col("started").isNotNull())
            .withColumn("duration_ms", datediff_boundary("millisecond", "started", "ended")))


def missing_run_markers(latest: DataFrame, delta: DataFrame, rollup: DataFrame, name: str = "name",
                        started: str = "started") -> DataFrame:
    """One -1/-1 run per entity whose newest known run the delta lacks.

    It tells that history was lost in between.  An hour that already carries
    a marker in ``rollup`` gets no second one.
    """
    newest = latest.groupBy(name).agg(F.max(started).alias(started))
    lost = newest.join(delta.select(name, started), [name, started], "left_anti")
    marked = rollup.filter("job_status = -1 AND steps_status = -1").select(name, "date", "hour")
    lost = lost.withColumns({"date": F.to_date(started), "hour": F.hour(started)})
    lost = lost.join(marked, [name, "date", "hour"], "left_anti")
    return lost.select(name, F.lit(-1).alias("job_status"), F.lit(-1).alias("steps_status"),
                       started, F.lit(0).cast("bigint").alias("duration_s"))


# Retention of the standard tables, (days, extra rule).
RETENTION_DAYS: Mapping[str, int] = {"snapshots": 90, "state_history": 1825, "hourly_rollup": 365}
