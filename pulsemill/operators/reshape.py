"""Unions, pivots and inline tables (inventory G)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunked import names


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """G3"""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out.distinct()


def pivot_state(df: DataFrame, group, keys: Sequence[str] | Mapping[str, str], key: str = "key",
                value: str = "value", extra: Mapping | None = None) -> DataFrame:
    """State rows to one row per group, one column per wanted key.

    A mapping gives the type of each key's column (``try_cast``, so bad text
    becomes null).  The key list is fixed: no pass to discover it.
    """
    types = keys if isinstance(keys, Mapping) else dict.fromkeys(keys)
    picked = {k: F.max(F.when(F.col(key) == k, F.col(value))) for k in types}
    typed = [(c if types[k] is None else c.try_cast(types[k])).alias(k) for k, c in picked.items()]
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return (df.filter(F.col(key).isin(list(types)))
            .groupBy(*names(group)).agg(*typed, *more))


def pivot_slots(df: DataFrame, group, slot: str, slots: Sequence[int], value: str,
                prefix: str = "h") -> DataFrame:
    """Numbered slots (the hours of a day) to columns."""
    wide = df.groupBy(*names(group)).pivot(slot, list(slots)).agg(F.max(value))
    return wide.withColumnsRenamed({str(s): f"{prefix}{s:02d}" for s in slots})


def unpivot_state(df: DataFrame, ids, cols: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    """Columns as text to (key, value) rows; nulls leave no row."""
    text = df.select(*names(ids), *[F.col(c).cast("string").alias(c) for c in cols])
    return text.unpivot(names(ids), list(cols), key, value).filter(F.col(value).isNotNull())


def inline_table(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A small constant table; joins broadcast it, so that its few keys don't gather a large table's rows in few tasks."""
    return F.broadcast(spark.createDataFrame(rows, schema))
