"""Counter snapshots to deltas (inventory I)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import datediff_boundary, safe_ratio
from .chunked import names, with_previous
from .joins import previous_snapshot_join
from .select import any_nonzero, newest_stamp

_COMPARE = {">": Column.__gt__, ">=": Column.__ge__}


def counter_delta(df: DataFrame, keys, ts: str, counters: Sequence[str], *, epoch: str | None = None,
                  clock: str | None = None, max_gap: int | None = None, gap_unit: str = "hour",
                  gap_op: str = ">", first: str = "null", prev: str = "row",
                  drop_zero: bool = True, chunk: Column | None = None) -> DataFrame:
    """What each cumulative counter gained since its previous observation.

    (keys, ts) identifies a row.  All rules look at the same previous row, so
    whatever the options there is one shuffle of the snapshots:

    ``prev``      'row': the entity's own previous row; 'snapshot': its row in
                  the previous snapshot of the whole table.
    ``max_gap``   more (``gap_op``) boundaries than this since then give null.
    ``first``     without a previous row: 'null', 'value' (the counter itself
                  is the gain) or 'absent' (no output row).
    ``epoch``     a changed epoch means a reset: the counter is the gain.
    ``clock``     a counter's clock running backwards means a reset.
    ``drop_zero`` drop rows on which no gain is known and non-zero.

    A falling value is a reset of that counter alone.  Adds ``delta_<counter>``.
    """
    if first not in ("null", "value", "absent"):
        raise ValueError(f"unknown first={first!r}")
    keys = names(keys)
    watched = [*counters, *(c for c in (epoch, clock) if c)]
    values = {f"_p_{c}": c for c in watched} | {"_p_at": ts}
    if prev == "row":
        out = with_previous(df, keys, ts, values, chunk)
    elif prev == "snapshot":
        out = previous_snapshot_join(df, keys, ts, values, "left", chunk)
    else:
        raise ValueError(f"unknown prev={prev!r}")
    if first == "absent":
        out = out.filter(F.col("_p_at").isNotNull())

    changed = F.lit(False)
    if epoch:
        changed = changed | F.coalesce(F.col(f"_p_{epoch}") != F.col(epoch), F.lit(False))
    if clock:
        changed = changed | F.coalesce(F.col(f"_p_{clock}") > F.col(clock), F.lit(False))
    stale = F.lit(False)
    if max_gap is not None:
        crossed = datediff_boundary(gap_unit, "_p_at", ts)
        stale = F.coalesce(_COMPARE[gap_op](crossed, F.lit(max_gap)), F.lit(False))

    def gain(c: str) -> Column:
        now, was = F.col(c), F.col(f"_p_{c}")
        unknown = was.isNull()
        if first == "null" and epoch:
            unknown = unknown | F.col(f"_p_{epoch}").isNull()
        at_first = now if first == "value" else F.lit(None)
        return (F.when(stale, None).when(unknown, at_first)
                .when(changed | (was > now), now).otherwise(now - was))

    out = out.withColumns({f"delta_{c}": gain(c) for c in counters}).drop(*values)
    return any_nonzero(out, [f"delta_{c}" for c in counters]) if drop_zero else out


def with_latency(deltas: DataFrame, stall: str, operations: str, name: str, scale: int | None = None) -> DataFrame:
    """Stall time per operation over a delta row; null without operations."""
    return deltas.withColumn(name, safe_ratio(stall, operations, scale))


def delta_from_first(df: DataFrame, session_keys, ts: str, counters: Sequence[str], *,
                     keep: Column | None = None, hours: int | None = None,
                     last_seen: Column | None = None) -> DataFrame:
    """A session's gain since its first sample, on its newest sample.

    One aggregate per session: the first value of each counter comes from all
    samples, the newest row from those that pass ``keep`` and lie within
    ``hours`` of the table's newest stamp.  ``last_seen`` (default: that
    stamp) gives ``seconds_since_last_seen``.
    """
    keys = names(session_keys)
    newest = newest_stamp(df, ts)
    wanted = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    if hours is not None:
        wanted = wanted & (datediff_boundary("hour", ts, newest) < hours)
    rest = [c for c in df.columns if c not in keys]
    per = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.when(wanted, F.col(ts))).alias("_row"),
        *[F.min_by(c, ts).alias(f"_first_{c}") for c in counters])
    out = per.filter(F.col("_row").isNotNull()).select(
        *keys, *[F.col("_row")[c].alias(c) for c in rest],
        *[(F.col("_row")[c] - F.col(f"_first_{c}")).alias(f"delta_{c}") for c in counters])
    seen = newest if last_seen is None else last_seen
    return out.withColumn("seconds_since_last_seen", datediff_boundary("second", ts, seen))


# Type codes of raw performance counters.
RAW_TYPES = (65536, 65792)
PER_SECOND_TYPES = (272696320, 272696576)
AVERAGE_TYPE = 1073874176
FRACTION_TYPE = 537003264
BASE_TYPE = 1073939712


def cook_counters(df: DataFrame, ts: str = "ts_utc", *, object_: str = "object", counter: str = "counter",
                  instance: str = "instance", value: str = "value", type_: str = "type",
                  integer_rate: bool = True, chunk: Column | None = None) -> DataFrame:
    """I4: raw performance counters to readable values, by type code.

    Raw types show the value; rates the gain per second (whole numbers unless
    ``integer_rate=False``); averages the gain over their base; fractions the
    value over their base, to three places.  A row needs its previous
    snapshot, 1 to 60 minute boundaries back; negative results are null, and a
    counter without its base (or with a base of 0) gives no row.  Rows of
    other types are not shown.
    """
    shown = (*RAW_TYPES, *PER_SECOND_TYPES, AVERAGE_TYPE, FRACTION_TYPE, BASE_TYPE)
    entity = [object_, counter, instance]
    rows = previous_snapshot_join(df, entity, ts, {"_was": value, "_was_at": ts}, chunk=chunk)
    rows = rows.filter(F.col(type_).isin(*shown))
    rows = rows.filter(datediff_boundary("minute", "_was_at", ts).between(1, 60))
    rows = rows.withColumns({"_gain": F.col(value) - F.col("_was"),
                             "_secs": datediff_boundary("second", "_was_at", ts)})
    kind = F.col(type_)
    whole = lambda num, den: F.expr(f"try_divide({num}, nullif({den}, 0L))")
    cut = (lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))) if integer_rate else (lambda c: c)

    # A counter and its base share object, instance, stamp and name stem: a
    # handful of rows, so one narrow window finds the base without a self join.
    stem = (F.when(kind == BASE_TYPE, F.regexp_extract(F.upper(counter), "^(.*?)BASE", 1))
            .when(kind == AVERAGE_TYPE, F.regexp_extract(F.upper(counter), r"^([^(]*)", 1))
            .otherwise(F.upper(counter)))
    related = Window.partitionBy(F.upper(object_), F.upper(instance), F.rtrim(stem), ts)
    usable = (kind == BASE_TYPE) & (F.col(value) != 0)
    rows = rows.withColumn("_bases", F.collect_list(F.when(usable, F.col(value))).over(related)).filter(kind != BASE_TYPE)

    alone = kind.isin(*RAW_TYPES, *PER_SECOND_TYPES)
    rows = rows.select("*", F.explode(F.when(alone, F.array(F.lit(1).cast("bigint"))).otherwise(F.col("_bases"))).alias("_base"))
    cooked = (F.when(kind.isin(*RAW_TYPES), F.col(value).cast("double"))
              .when(kind.isin(*PER_SECOND_TYPES), cut(whole("_gain", "_secs")).cast("double"))
              .when(kind == AVERAGE_TYPE, cut(whole("_gain", "_base")).cast("double"))
              .when(kind == FRACTION_TYPE, F.round(whole(value, "_base"), 3).cast("double")))
    return rows.withColumn("cooked_value", F.when(cooked >= 0, cooked)).select(*df.columns, "cooked_value")


def ratio_at_stamp(df: DataFrame, keys, ts: str, value: str, numerator: Column, denominator: Column,
                   name: str = "ratio", lift_zero: bool = True, scale: int | None = None) -> DataFrame:
    """One counter over another at the same stamp, in one grouping.

    Only (keys, ts) that have both counters give a row.
    """
    pair = df.filter(numerator | denominator).groupBy(*names(keys), ts).agg(
        F.max(F.when(numerator, F.col(value))).alias("_num"), F.count_if(numerator).alias("_has_num"),
        F.max(F.when(denominator, F.col(value))).alias("_den"), F.count_if(denominator).alias("_has_den"))
    pair = pair.filter("_has_num > 0 AND _has_den > 0")
    return pair.select(*names(keys), ts, safe_ratio("_num", "_den", scale, lift_zero).alias(name))


def query_deltas(df: DataFrame, query_keys, plan_keys, ts: str, counters: Sequence[str], *,
                 epoch: str | None = None, max_gap: int = 12, gap_op: str = ">=",
                 chunk: Column | None = None) -> DataFrame:
    """Deltas per plan version, summed to the query.

    Statements of one plan are added up first; the delta rule is I1 with the
    previous snapshot and a first sight counted in full.
    """
    q, p = names(query_keys), names(plan_keys)
    extra = [epoch] if epoch else []
    per_plan = df.groupBy(*q, *p, ts).agg(*[F.sum(c).alias(c) for c in counters], *[F.max(e).alias(e) for e in extra])
    deltas = counter_delta(per_plan, [*q, *p], ts, counters, epoch=epoch, max_gap=max_gap, gap_op=gap_op,
                           first="value", prev="snapshot", chunk=chunk)
    return deltas.groupBy(*q, ts).agg(*[F.sum(f"delta_{c}").alias(c) for c in counters])


# The rules of the seven delta sources.
DELTA_RULES: Mapping[str, Mapping] = {
    "cpu_per_database": dict(drop_zero=False),
    "wait_statistics": dict(epoch="restart_ts", max_gap=12, gap_op=">"),
    "database_io": dict(clock="sample_ms"),
    "missing_indexes": dict(epoch="restart_ts"),
    "index_usage": dict(epoch="restart_ts", prev="snapshot", first="absent"),
    "index_operational": dict(epoch="restart_ts"),
    "query_statistics": dict(epoch="restart_ts", prev="snapshot", first="value", max_gap=12, gap_op=">="),
}
