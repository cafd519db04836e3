"""The given tables, and canonical shapes derived from them by Spark."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


class Tables:
    """Lazy access to one data folder; stamps are read as UTC instants."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def snapshots(self) -> DataFrame:
        """Hourly counter snapshots: 20 entities, counters that restart each week.

        A running sum over at most the 168 hours of one entity and week.
        """
        hourly = self.events.groupBy((F.col("user_id") % 20).alias("entity"), F.date_trunc("hour", "ts").alias("ts")).agg(
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"), F.count(F.lit(1)).alias("n"))
        epoch = F.date_trunc("week", "ts")
        w = Window.partitionBy("entity", epoch).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return hourly.select("entity", "ts", epoch.alias("epoch"), F.sum("v").over(w).alias("total"),
                             F.sum("n").over(w).alias("hits"),
                             (F.unix_millis("ts") - F.unix_millis(epoch)).alias("sample_ms"))

    @cached_property
    def history(self) -> DataFrame:
        """Run history: a user is a job, a purchase its summary row, an error a failed step."""
        e = self.events
        step = F.when(F.col("event_type") == "purchase", 0).otherwise(F.col("event_id") % 5 + 1)
        status = (F.when(F.col("event_type") == "error", 0).when(F.col("value") > 150, 3).otherwise(1))
        return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), step.cast("int").alias("step"),
                        status.alias("status"), F.col("ts").alias("started"),
                        F.floor("value").cast("bigint").alias("duration_s"))

    @cached_property
    def schedules(self) -> DataFrame:
        """One schedule per order: recurrence and hours follow from its key and date."""
        k = F.col("o_orderkey")
        start = (k % 20).cast("int")
        return self.orders.select(
            k.alias("job"), (k % 7).cast("int").alias("schedule_id"), (k % 2 == 0).alias("enabled"),
            F.when(k % 3 == 0, 4).when(k % 3 == 1, 8).otherwise(1).alias("freq_type"),
            (k % 127 + 1).cast("int").alias("freq_interval"),
            F.when(k % 4 == 0, 1).when(k % 4 == 1, 2).when(k % 4 == 2, 4).otherwise(8).alias("subday_type"),
            (k % 5 + 1).cast("int").alias("subday_interval"), (k % 2 + 1).cast("int").alias("recurrence"),
            (F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")).alias("start_date"),
            F.when(k % 10 == 0, 19991231).otherwise(99991231).alias("end_date"),
            (start * 10000 + 1500).alias("start_time"), ((start + 3) * 10000 + 3000).alias("end_time"))

    @cached_property
    def order_states(self) -> DataFrame:
        """State observations: a customer's order status and priority, seen at each order."""
        kv = lambda key, col: F.struct(F.lit(key).alias("key"), F.col(col).alias("value"))
        return self.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
                                  F.inline(F.array(kv("status", "o_orderstatus"), kv("priority", "o_orderpriority"))))

    @cached_property
    def state(self) -> DataFrame:
        """The history of ``order_states``, one day per observation, last order of the day."""
        from ..operators.chunked import by_year, newest_per_group
        from ..operators.state import scd2_build
        daily = newest_per_group(self.order_states, ["entity", "key", "ts"], "seq")
        return scd2_build(daily, ["entity", "key"], "ts", "value", chunk=by_year("ts"))


def plain(df: DataFrame) -> DataFrame:
    """Output types that every engine prints alike: text, BIGINT, DOUBLE."""
    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            return c.cast("double").alias(f.name)
        return c
    return df.select(*[one(f) for f in df.schema])
