"""Dimensional model (inventory K)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import calendar_columns, hash_key
from .reshape import inline_table, union_distinct


@dataclass(frozen=True)
class DimensionSource:
    """One fact's contribution: up to six columns, under the dimension's names."""
    fact: DataFrame
    columns: Mapping[str, str]
    where: Column | None = None


def build_dimension(sources: Sequence[DimensionSource], key: str) -> DataFrame:
    """K1: distinct members over all sources, with a hashed key.

    Members that differ only in case share a key and are one member; the
    spelling kept is the least one.  Each source is reduced map-side first.
    """
    parts = []
    for s in sources:
        rows = s.fact if s.where is None else s.fact.filter(s.where)
        parts.append(rows.select(*[F.col(src).cast("string").alias(out) for out, src in s.columns.items()]).distinct())
    columns = list(sources[0].columns)
    members = union_distinct(*parts).withColumn(key, hash_key(*columns))
    return members.groupBy(key).agg(F.min(F.struct(*columns)).alias("_m")).select(
        key, *[F.col("_m")[c].alias(c) for c in columns])


def date_dimension(facts: Sequence[tuple[DataFrame, str]], today: Column) -> DataFrame:
    """K2: every day from the first to the last calendar year of any fact."""
    spans = [f.select(F.min(F.year(d)).alias("lo"), F.max(F.year(d)).alias("hi")) for f, d in facts]
    span = spans[0]
    for s in spans[1:]:
        span = span.unionByName(s)
    span = span.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first, last = F.make_date("lo", F.lit(1), F.lit(1)), F.make_date("hi", F.lit(12), F.lit(31))
    days = span.select(F.explode(F.sequence(first, last)).alias("date"))
    return days.select("date", *[c.alias(n) for n, c in calendar_columns("date", today).items()])


def time_dimension(spark: SparkSession) -> DataFrame:
    """K3: the 86 400 seconds of a day."""
    s = F.col("id")
    return spark.range(86_400).select(
        s.alias("time_key"), F.date_format(F.timestamp_seconds(s), "HH:mm:ss").alias("time"),
        F.floor(s / 3600).cast("int").alias("hour"), (F.floor(s / 60) % 60).cast("int").alias("minute"),
        (s % 60).cast("int").alias("second"))


def junk_dimension(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """K4"""
    return inline_table(spark, schema, rows)


@dataclass(frozen=True)
class KeySpec:
    """A hashed key over fact columns; a null column reads ``null`` if given."""
    name: str
    columns: Sequence[str]
    null: Mapping[str, str] = field(default_factory=dict)


def attach_keys(fact: DataFrame, specs: Sequence[KeySpec]) -> DataFrame:
    """K5: a hierarchy of keys (database, schema, object, index, partition)."""
    def col(spec: KeySpec, c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(spec.null[c])) if c in spec.null else F.col(c)

    return fact.withColumns({s.name: hash_key(*[col(s, c) for c in s.columns]) for s in specs})


@dataclass(frozen=True)
class Relation:
    """fact column -> dimension key.  Inactive relations join only when asked for;
    with ``both_ways`` a filter on the dimension also restricts the fact."""
    name: str
    dimension: DataFrame
    fact_key: str
    dim_key: str
    active: bool = True
    both_ways: bool = False
    broadcast: bool = False


def star_join(fact: DataFrame, relations: Sequence[Relation], use_inactive: Sequence[str] = ()) -> DataFrame:
    """K6: many-to-one joins of a fact with its dimensions.

    Catalyst and AQE choose between broadcast and shuffled joins by size;
    ``broadcast`` states it, for a dimension whose size is known to be bounded
    (dates, codes).  Dimension columns arrive as ``<relation>_<column>``.
    """
    for r in relations:
        if not (r.active or r.name in use_inactive):
            continue
        dim = r.dimension.select(F.col(r.dim_key).alias("_dk"),
                                 *[F.col(c).alias(f"{r.name}_{c}") for c in r.dimension.columns if c != r.dim_key])
        if r.broadcast:
            dim = F.broadcast(dim)
        how = "inner" if r.both_ways else "left"
        fact = fact.join(dim, F.col(r.fact_key) == F.col("_dk"), how).drop("_dk")
    return fact


def restrict_dimension(dimension: DataFrame, dim_key: str, fact: DataFrame, fact_key: str) -> DataFrame:
    """K6, the other way: members that the (filtered) fact still has."""
    return dimension.join(fact.select(F.col(fact_key).alias("_fk")).distinct(),
                          F.col(dim_key) == F.col("_fk"), "left_semi")


def dimension_rows(spark: SparkSession, items: Mapping[int, str], key: str, label: str) -> DataFrame:
    """K4 for codes: (code, label, sort order)."""
    rows = [(code, text, i) for i, (code, text) in enumerate(items.items(), 1)]
    return inline_table(spark, f"{key} int, {label} string, sort_order int", rows)

