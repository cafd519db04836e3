"""Reading and writing snapshot tables (inventory A)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.chunked import names
from .schemas import SHAPES

PARTITION = "date"


def _struct(schema: str | T.StructType) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return T.StructType.fromDDL(SHAPES.get(schema, schema))


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The schema's columns in order; absent ones become typed nulls."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[
        (F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in _struct(schema)])


def read_snapshots(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet",
                   reconcile: str = "stated", **options) -> DataFrame:
    """A1: a snapshot table from Parquet, ORC, JSON or CSV files.

    ``schema`` is a DDL string, a StructType or the name of a canonical
    shape.  Files may be of several generations: a column that a file lacks is
    null in that file's rows, whichever file comes first.

    'stated' reads every file with the stated types and opens no footer in advance;
    narrower numbers of older files are widened, and a file whose type can't be
    widened is an error.  'merged' takes the types from all footers (a job of its
    own) and casts them, for tables whose files have wider types, or others.
    """
    wanted = _struct(schema)
    reader = spark.read.format(fmt).options(**options)
    if reconcile == "merged" and fmt not in ("json", "csv"):
        found = _merged_types(spark, path, fmt, options)
        wide = T.StructType([T.StructField(f.name, found.get(f.name.lower(), f.dataType)) for f in wanted])
        return conform(reader.schema(wide).load(path), wanted)
    return conform(reader.schema(wanted).load(path), wanted)


def _merged_types(spark: SparkSession, path: str, fmt: str, options: Mapping[str, str]) -> dict[str, T.DataType]:
    merged = spark.read.format(fmt).options(**options).option("mergeSchema", "true").load(path).schema
    return {f.name.lower(): f.dataType for f in merged}


def absent_columns(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", **options) -> list[str]:
    """Columns of ``schema`` that no file of the table has; all footers are read."""
    found = _merged_types(spark, path, fmt, options)
    return [f.name for f in _struct(schema) if f.name.lower() not in found]


def stamp(df: DataFrame, ts_utc: Column, zone: str, utc: str = "ts_utc", local: str = "ts") -> DataFrame:
    """A2: one UTC and one local stamp for all rows of a poll."""
    return df.withColumn(utc, ts_utc).withColumn(local, F.from_utc_timestamp(utc, zone))


def _by_day(df: DataFrame, ts: str, spread: bool) -> DataFrame:
    """Add the day; with ``spread``, one shuffle gives each day few, well-sized
    files, and AQE splits a day that is too big for one task."""
    out = df.withColumn(PARTITION, F.to_date(ts))
    return out.hint("rebalance", PARTITION) if spread else out


def append_snapshot(df: DataFrame, path: str, ts: str = "ts_utc", sort: Sequence[str] = (),
                    spread: bool = False) -> None:
    """A3: append, partitioned by day; rows are sorted inside each file for pruning.

    A poll has one day and needs no shuffle; set ``spread`` for a backfill of
    many days.
    """
    out = _by_day(df, ts, spread)
    if sort:
        out = out.sortWithinPartitions(PARTITION, *sort)
    out.write.mode("append").partitionBy(PARTITION).parquet(path)


def insert_if_absent(new: DataFrame, existing: DataFrame, keys) -> DataFrame:
    """A4: rows of ``new`` whose key ``existing`` lacks; null equals null."""
    keys = names(keys)
    known = existing.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return new.join(known, on, "left_anti")


def insert_if_no_neighbour(new: DataFrame, existing: DataFrame, ts: str, tol_s: int, by=()) -> DataFrame:
    """A5: drop new events within +/- ``tol_s`` seconds of a known one.

    Time is cut into buckets one tolerance wide.  What matters of the known
    events is, for each bucket, whether it holds one, the last of the bucket
    before and the first of the bucket after; that is one row per bucket, so
    a new event meets one row, never a list of candidates.
    """
    by = names(by)
    width = tol_s * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    known = (existing.select(*by, micros.alias("_us")).withColumn("_b", F.floor(F.col("_us") / width))
             .groupBy(*by, "_b").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi")))
    shifted = known.select(*by, "_b", "_lo", "_hi", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("_o"))
    near = (shifted.groupBy(*by, (F.col("_b") + F.col("_o")).alias("_kb"))
            .agg(F.max(F.col("_o") == 0).alias("_here"), F.max(F.when(F.col("_o") == 1, F.col("_hi"))).alias("_before"),
                 F.min(F.when(F.col("_o") == -1, F.col("_lo"))).alias("_after")))
    near = near.withColumnsRenamed({k: f"_k_{k}" for k in by})
    work = new.withColumn("_us", micros).withColumn("_b", F.floor(F.col("_us") / width))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], F.col("_b") == F.col("_kb"))
    close = (F.col("_here") | (F.col("_before") >= F.col("_us") - width) | (F.col("_after") <= F.col("_us") + width))
    return work.join(near, on & F.coalesce(close, F.lit(False)), "left_anti").select(*new.columns)


def read_since(df: DataFrame, watermark: DataFrame, entity, ts: str, inclusive: bool = True,
               mark: str | None = None, unmarked_from: Column | None = None) -> DataFrame:
    """Rows at or after each entity's own watermark, and entities that have none.

    Of entities without a watermark all rows come, or with ``unmarked_from``
    those at or after it; give it where entities that are new can't have older
    rows.  Then the smaller of it and the oldest watermark bounds all rows, and
    reaches the scan as a pushed filter.
    """
    entity, mark = names(entity), mark or ts
    wm = watermark.select(*[F.col(e).alias(f"_k_{e}") for e in entity], F.col(mark).alias("_mark"))
    on = reduce(Column.__and__, [F.col(e).eqNullSafe(F.col(f"_k_{e}")) for e in entity])
    due = F.col(ts) >= F.col("_mark") if inclusive else F.col(ts) > F.col("_mark")
    unmarked = F.col("_mark").isNull()
    if unmarked_from is not None:
        df = df.filter(F.col(ts) >= wm.select(F.least(F.min("_mark"), unmarked_from)).scalar())
        unmarked = unmarked & (F.col(ts) >= unmarked_from)
    return df.join(wm, on, "left").filter(unmarked | due).select(*df.columns)


def write_partition(df: DataFrame, path: str, ts: str = "ts_utc", spread: bool = False) -> None:
    """Replace the rows of whole snapshots; safe to run again.

    A folder holds an hour of snapshots: with a poll a minute, 24 folders a
    day and not 1440.  The other snapshots of the hours that ``df`` touches
    are read and written again with it, with all the columns that any file of
    those hours or ``df`` has; a column that one side lacks is null there.
    """
    spark = df.sparkSession
    new = df.withColumns({PARTITION: F.to_date(ts), "hour": F.hour(ts)})
    hours = new.select(PARTITION, "hour").distinct()
    # 24 a day: the folders of which files are read, and whose footers are merged.
    touched = [f"{path}/{PARTITION}={r[0]}/hour={r.hour}" for r in hours.collect()]
    there = [f for f in touched if _exists(spark, f)]
    if there:
        old = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*there)
        beside = old.join(new.select(ts).distinct(), ts, "left_anti")
        new = new.unionByName(beside, allowMissingColumns=True)
    if spread:
        new = new.hint("rebalance", PARTITION, "hour")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION, "hour").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def replace_days(df: DataFrame, path: str, date: str = PARTITION) -> None:
    """Replace whole days of a date-partitioned table (rollups, retention).

    ``df`` may read the same table: its new days are staged in full before
    the old ones go.
    """
    (df.hint("rebalance", date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(date).parquet(path))


def _days(spark: SparkSession, path: str, date: str) -> list[str]:
    """The days of a date-partitioned table, by its folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    folders = [f.getPath().getName() for f in found if f.isDirectory()]
    return sorted(f.split("=", 1)[1] for f in folders if f.startswith(f"{date}=") and f[len(date) + 1:len(date) + 2].isdigit())


def retain_days(spark: SparkSession, path: str, ts: str, rules: Sequence[tuple[int, Column | None]],
                date: str = PARTITION) -> tuple[list[str], list[str]]:
    """H10 on a table of day folders: what ``apply_retention`` keeps, with as little work as it takes.

    The folder names are the catalogue: a day that lies wholly before the limit
    of a rule without a filter is dropped unread.  Of a rule with a filter
    the days that hold such rows are found by a scan with the filter pushed
    down, and only they and the days of the limits are written again.  The
    newest stamp comes from the newest day.  Returns the days dropped and the
    days written again; running it again changes nothing more.
    """
    days = _days(spark, path, date)
    jvm, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def drop(day: str) -> None:
        folder = jvm(f"{path}/{date}={day}")
        folder.getFileSystem(conf).delete(folder, True)

    def read(some: Sequence[str]) -> DataFrame:
        return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*[f"{path}/{date}={d}" for d in some])

    newest = None
    for day in reversed(days):  # the first of them, unless it is empty
        newest = read([day]).agg(F.max(ts)).first()[0]
        if newest is not None:
            break
    if newest is None:
        return [], []
    limits = [(spark.range(1).select(F.timestamp_add("DAY", F.lit(-n), F.lit(newest)).alias("t"))
               .select("t", F.to_date("t").cast("string").alias("d")).first(), only) for n, only in rules]
    edge = max((limit.d for limit, only in limits if only is None), default="")
    gone = [d for d in days if d < edge]
    for day in gone:
        drop(day)
    keep, touched = F.lit(True), {edge} & set(days)
    for limit, only in limits:
        old = F.col(ts) < F.lit(limit.t)
        out = old if only is None else old & F.coalesce(only, F.lit(False))
        keep = keep & ~out
        before = [d for d in days if edge <= d <= limit.d]
        if only is not None and before:
            touched |= {str(r[0]) for r in read(before).filter(out).select(F.col(date).cast("string")).distinct().collect()}
    if not touched:
        return gone, []
    rows = read(sorted(touched))
    changed = rows.groupBy(F.col(date).cast("string").alias("d")).agg(
        F.count_if(F.coalesce(keep, F.lit(True))).alias("kept"), F.count(F.lit(1)).alias("n")).filter("kept < n").collect()
    rewritten = sorted(r.d for r in changed if r.kept)
    if rewritten:
        replace_days(read(rewritten).filter(F.coalesce(keep, F.lit(True))), path, date)
    emptied = sorted(r.d for r in changed if not r.kept)
    for day in emptied:
        drop(day)
    return gone + emptied, rewritten


def select_services(loads: Sequence[str], tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The chosen tables; the others keep their schema but are never read."""
    return {n: t if n in loads else t.sparkSession.createDataFrame([], t.schema) for n, t in tables.items()}
