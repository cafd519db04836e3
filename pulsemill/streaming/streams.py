"""Streaming forms of the batch operators (inventory M)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunked import names, newest_per_group
from ..operators.counters import counter_delta
from ..operators.joins import null_safe_join
from ..operators.select import OPEN_END
from ..operators.state import inventory_history, scd2_build
from ..session import drop_path, path_exists


def stream_dedup(events: DataFrame, keys, ts: str, delay: str) -> DataFrame:
    """M2: the first event per key; state is kept for ``delay`` only."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(names(keys))


def stream_rollup(events: DataFrame, keys, ts: str, value: str, delay: str, every: str = "1 hour") -> DataFrame:
    """M3: hourly count, sum, min and max; late rows within ``delay`` still count.

    For update or append mode.  Partial aggregation runs before the shuffle,
    so a hot key sends one row per task and hour.
    """
    return (events.withWatermark(ts, delay).groupBy(*names(keys), F.window(ts, every).alias("_w"))
            .agg(F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("sum_s"),
                 F.min(value).alias("min_s"), F.max(value).alias("max_s"))
            .select(*names(keys), F.col("_w.start").alias("hour_start"), "cnt", "sum_s", "min_s", "max_s"))


def stream_missing_heartbeat(events: DataFrame, entity, ts: str, silent_for: str, delay: str) -> DataFrame:
    """M5: an entity's last sign of life, emitted once it has been silent that long.

    For append mode: a session closes when the watermark passes its end.
    """
    return (events.withWatermark(ts, delay).groupBy(*names(entity), F.session_window(ts, silent_for).alias("_s"))
            .agg(F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("events"))
            .select(*names(entity), "last_seen", F.col("_s.end").alias("silent_since"), "events"))


def stream_snapshot_sink(snapshots: DataFrame, path: str, checkpoint: str, ts: str = "ts_utc",
                         **trigger) -> StreamingQuery:
    """M6: append snapshots to a day-partitioned Parquet table, exactly once."""
    return (snapshots.withColumn("date", F.to_date(ts)).writeStream.format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).partitionBy("date")
            .trigger(**(trigger or {"availableNow": True})).start())


class BatchState:
    """A table kept between micro-batches, in two folders used in turn.

    Batch n reads what batch n-1 wrote and overwrites the other folder.  A
    batch that runs again after a failure finds its input untouched, because
    batch n+1 starts only after batch n is committed.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _folder(self, batch: int) -> str:
        return f"{self.root}/slot={batch % 2}"

    def before(self, like: DataFrame, batch: int) -> DataFrame | None:
        return None if batch == 0 else like.sparkSession.read.schema(like.schema).parquet(self._folder(batch - 1))

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(batch))

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.parquet(self._folder(batch))


class KeyedState:
    """One row per key kept between micro-batches, as a log: a batch writes the keys it changes and no others.

    Each batch has a folder.  That of every ``every``-th batch holds the whole
    state, the others what changed; a key's row is the newest from the last
    whole folder on.  Folders are sorted by ``buckets`` of the key's hash, so
    a batch that names the buckets of its keys skips the files of the others.
    A batch that runs again overwrites its own folder and reads those of
    batches before it only.  The last whole folder but one stays with what follows it.
    """

    BATCH, BUCKET = "state_batch", "state_bucket"

    def __init__(self, root: str, buckets: int = 256, every: int = 32):
        self.root, self.buckets, self.every = root.rstrip("/"), buckets, every

    def _folder(self, batch: int) -> str:
        return f"{self.root}/batch={batch}"

    def _bucket(self, keys: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias(self.BUCKET)

    def _newest(self, spark: SparkSession, keys: Sequence[str], shape: T.StructType, batch: int, only: Sequence[int] | None) -> DataFrame:
        stored = T.StructType([*shape.fields, T.StructField(self.BATCH, T.LongType()), T.StructField(self.BUCKET, T.IntegerType())])
        first = batch - batch % self.every
        rows = spark.read.schema(stored).parquet(*[self._folder(i) for i in range(first, batch + 1)])
        if only is not None:
            rows = rows.filter(F.col(self.BUCKET).isin(list(only)))
        return newest_per_group(rows, keys, self.BATCH)

    def before(self, like: DataFrame, keys: Sequence[str], batch: int, wanted: DataFrame) -> DataFrame:
        """The rows of the keys in ``wanted`` as batch ``batch`` finds them, with the columns of ``like``."""
        if batch == 0:
            return like.filter(F.lit(False))
        only = [r[0] for r in wanted.select(self._bucket(keys)).distinct().collect()]  # at most ``buckets``
        held = self._newest(like.sparkSession, keys, like.schema, batch - 1, only).drop(self.BATCH, self.BUCKET)
        return null_safe_join(held, wanted.select(*keys).distinct(), keys, "left_semi")

    def write(self, changed: DataFrame, keys: Sequence[str], batch: int, keep: Column | None = None) -> None:
        """``keep`` tells which rows still matter; the others go, with the next whole folder at the latest."""
        spark = changed.sparkSession
        rows = changed.withColumn(self.BATCH, F.lit(batch).cast("bigint")).withColumn(self.BUCKET, self._bucket(keys))
        if batch and batch % self.every == 0:
            rows = newest_per_group(rows.unionByName(self._newest(spark, keys, changed.schema, batch - 1, None)), keys, self.BATCH)
        if keep is not None:
            rows = rows.filter(keep)
        (rows.repartitionByRange(self.BUCKET).sortWithinPartitions(self.BUCKET)
         .write.mode("overwrite").parquet(self._folder(batch)))
        if batch % self.every == 0:
            for old in range(max(0, batch - 2 * self.every), batch - self.every):
                drop_path(spark, self._folder(old))

    def read(self, spark: SparkSession, keys_of: Callable[[Sequence[str]], Sequence[str]], batch: int) -> DataFrame:
        """The whole state after a batch; ``keys_of`` picks the keys among its columns."""
        shape = spark.read.parquet(self._folder(batch)).drop(self.BATCH, self.BUCKET).schema
        return self._newest(spark, keys_of(shape.names), shape, batch, None).drop(self.BATCH, self.BUCKET)


Hold = Callable[[DataFrame], DataFrame]


def _each_batch(work: Callable[[DataFrame, int, Hold], None]) -> Callable[[DataFrame, int], None]:
    """Keep a micro-batch while ``work`` reads it several times, and what ``work`` asks to hold
    (rows of the batch's keys); what an executor loses is read from the sources again."""
    def run(batch: DataFrame, batch_id: int) -> None:
        held = [batch.persist()]

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        try:
            work(batch, batch_id, hold)
        finally:
            for df in reversed(held):
                df.unpersist()
    return run


def _write_batch(df: DataFrame, batch: int, path: str) -> None:
    """Rows of one batch in their own partition; run again, they are replaced."""
    (df.withColumn("batch_id", F.lit(batch)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def _start(stream: DataFrame, run: Callable[[DataFrame, int, Hold], None], checkpoint: str,
           trigger: Mapping[str, object] | None) -> StreamingQuery:
    """``trigger`` as in ``DataStreamWriter.trigger``; by default what is there is drained, then the query ends."""
    return (stream.writeStream.foreachBatch(_each_batch(run)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _at_or_before(position: Sequence[str], last: str) -> Column:
    return F.coalesce(F.struct(*position) <= F.col(last), F.lit(False))


def stream_counter_delta(snapshots: DataFrame, keys, ts: str, counters: Sequence[str], out: str,
                         state_root: str, checkpoint: str, delay_s: int = 0, epoch: str | None = None,
                         clock: str | None = None, expire_s: int | None = None,
                         trigger: Mapping[str, object] | None = None, **options) -> StreamingQuery:
    """M1: I1 over a stream, exact for rows up to ``delay_s`` out of order.

    Each micro-batch is put to the rows held back so far and the last row
    released per entity, and the batch operator runs on them.  Rows newer
    than (newest stamp - delay) wait.  A row is late if its own entity has
    released that stamp or a newer one, so a poll that is split over batches
    loses nothing; late rows are no part of the deltas and go to
    ``<state_root>/late``, by batch, where they can be counted.

    ``expire_s``: an entity that has been silent for longer than this, by the
    newest stamp, is forgotten and starts over when it comes back.  Take the
    gap limit, or more: a longer gap gives no delta anyhow.

    A batch reads and writes the released rows of its own entities
    (``KeyedState``); those held back are written with every batch.
    """
    keys = names(keys)
    keep = [*keys, ts, *counters, *(c for c in (epoch, clock) if c)]
    waits, released = BatchState(state_root), KeyedState(f"{state_root.rstrip('/')}/released")
    if options.get("prev", "row") != "row":
        raise ValueError("a stream compares with the entity's own previous row")

    def run(batch: DataFrame, batch_id: int, hold: Hold) -> None:
        # role: 'wait' a row held back, 'mark' (no keys) the newest stamp so far.
        rows = batch.select(*keep, F.lit("wait").alias("role"))
        held = waits.before(rows, batch_id)
        everything = rows if held is None else rows.unionByName(held)
        newest = everything.select(F.max(ts)).scalar()
        limit = F.timestamp_add("SECOND", F.lit(-delay_s), newest)
        waiting = everything.filter("role = 'wait'").drop("role")
        due = hold(waiting.filter(F.col(ts) <= limit))
        base = hold(released.before(due, keys, batch_id, due))
        fresh = None
        if expire_s is not None:
            known = everything.filter("role = 'mark'").select(F.max(ts)).scalar()
            base = base.filter(F.col(ts) >= F.timestamp_add("SECOND", F.lit(-expire_s), known))
            fresh = F.col(ts) >= F.timestamp_add("SECOND", F.lit(-expire_s), newest)
        placed = hold(null_safe_join(due, base.select(*keys, F.struct(ts).alias("_last")), keys, "left"))
        late = _at_or_before([ts], "_last")
        _write_batch(placed.filter(late).drop("_last"), batch_id, f"{waits.root}/late")
        on_time = placed.filter(~late).drop("_last")
        both = base.withColumn("role", F.lit("base")).unionByName(on_time.withColumn("role", F.lit("wait")))
        deltas = counter_delta(both, keys, ts, counters, epoch=epoch, clock=clock, **options)
        _write_batch(deltas.filter("role = 'wait'").drop("role"), batch_id, out)
        released.write(newest_per_group(both.drop("role"), keys, ts), keys, batch_id, fresh)
        still = waiting.filter(F.col(ts) > limit).withColumn("role", F.lit("wait"))
        mark = everything.agg(F.max(ts).alias(ts)).filter(F.col(ts).isNotNull()).withColumn("role", F.lit("mark"))
        waits.write(still.unionByName(mark, allowMissingColumns=True), batch_id)

    return _start(snapshots, run, checkpoint, trigger)


class StreamedHistory:
    """A history kept by a stream: open rows as state, closed rows append-only.

    Full inventories rewrite their open rows with each poll (``open``); where
    a batch changes some keys only, open rows are a log (``current``), stored
    as keys, value, valid_from and valid_to.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.open_rows = BatchState(f"{self.root}/open")
        self.current = KeyedState(f"{self.root}/current")
        self.closed = f"{self.root}/closed"

    def write(self, history: DataFrame, batch: int, keys: Sequence[str] | None = None) -> None:
        """With ``keys`` the batch's open rows replace those of the same keys, otherwise all of them."""
        still_open = F.col("valid_to") == F.lit(OPEN_END).cast("timestamp")
        _write_batch(history.filter(~still_open), batch, self.closed)
        if keys is None:
            self.open_rows.write(history.filter(still_open), batch)
        else:
            value = next(c for c in history.columns if c not in {*keys, "valid_from", "valid_to"})
            self.current.write(history.filter(still_open).select(*keys, value, "valid_from", "valid_to"), keys, batch)

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        """The history as of a batch."""
        if path_exists(spark, self.current.root):
            now = self.current.read(spark, lambda columns: columns[:-3], batch)
        else:
            now = self.open_rows.read(spark, batch)
        shape = T.StructType([*now.schema.fields, T.StructField("batch_id", T.IntegerType())])
        closed = spark.read.schema(shape).parquet(self.closed)
        return now.unionByName(closed.filter(F.col("batch_id") <= batch).drop("batch_id"))


def stream_scd2(observations: DataFrame, keys, ts: str, value: str, root: str, checkpoint: str,
                order: Sequence[str] = (), delay_s: int = 0, trigger: Mapping[str, object] | None = None,
                expire_s: int | None = None) -> StreamingQuery:
    """M4: a history kept by micro-batches of observations, exact for rows up to ``delay_s`` out of order.

    A batch may change a key several times: its observations and the open
    rows give one history (H2); what that closes is appended, what stays
    open is the next state.  A batch reads and writes the open rows of its
    own keys (``KeyedState``), not all of them and no history.  Observations newer than (newest stamp - delay)
    wait.  One at or before the last that its key has taken in is late: it
    can't change rows already closed, so it goes to ``<root>/late``, by
    batch, and the history stays free of overlaps.

    ``expire_s``: an observation older than this, by the newest stamp of the
    batches before, is late for every key; so what a key has taken in last is
    forgotten after that time.  Open rows stay, they are the result.
    """
    keys, history = names(keys), StreamedHistory(root)
    position = ["observed_at", *order]
    pending, marks = BatchState(f"{history.root}/pending"), KeyedState(f"{history.root}/last")

    def run(batch: DataFrame, batch_id: int, hold: Hold) -> None:
        # role: 'wait' an observation held back, 'mark' (no keys) the newest stamp so far.
        seen = batch.select(*keys, F.col(ts).alias("observed_at"), *order, value, F.lit("wait").alias("role"))
        held = pending.before(seen, batch_id)
        everything = seen if held is None else seen.unionByName(held)
        newest = everything.select(F.max("observed_at")).scalar()
        limit = F.timestamp_add("SECOND", F.lit(-delay_s), newest)
        waiting = everything.filter("role = 'wait'").drop("role")
        due = hold(waiting.filter(F.col("observed_at") <= limit))
        last = hold(marks.before(due.select(*keys, *position), keys, batch_id, due))
        placed = hold(null_safe_join(due, last.select(*keys, F.struct(*position).alias("_last")), keys, "left"))
        late, fresh = _at_or_before(position, "_last"), None
        if expire_s is not None:
            known = everything.filter("role = 'mark'").select(F.max("observed_at")).scalar()
            late = late | F.coalesce(F.col("observed_at") < F.timestamp_add("SECOND", F.lit(-expire_s), known), F.lit(False))
            fresh = F.col("observed_at") >= F.timestamp_add("SECOND", F.lit(-expire_s), newest)
        _write_batch(placed.filter(late).drop("_last"), batch_id, f"{history.root}/late")
        taken = placed.filter(~late).drop("_last")
        shape = taken.select(*keys, value, F.col("observed_at").alias("valid_from"), F.col("observed_at").alias("valid_to"))
        opened = hold(history.current.before(shape, keys, batch_id, taken))
        opened = opened.select(*keys, F.col("valid_from").alias("observed_at"), value)
        rows = taken.unionByName(opened, allowMissingColumns=True)
        history.write(hold(scd2_build(rows, keys, "observed_at", value, order)), batch_id, keys)
        kept = newest_per_group(last.unionByName(taken.select(*keys, *position)), keys, position)
        marks.write(kept, keys, batch_id, fresh)
        still = waiting.filter(F.col("observed_at") > limit).withColumn("role", F.lit("wait"))
        mark = (everything.agg(F.max("observed_at").alias("observed_at")).filter(F.col("observed_at").isNotNull())
                .withColumn("role", F.lit("mark")))
        pending.write(still.unionByName(mark, allowMissingColumns=True), batch_id)

    return _start(observations, run, checkpoint, trigger)


def stream_inventory(inventories: DataFrame, keys, ts: str, value: str, root: str, checkpoint: str,
                     hold_newest: bool = True, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """M4 for full inventories: rows that share a stamp are one poll; vanished keys are closed.

    A batch may hold several polls, or a part of one: with ``hold_newest``
    the newest poll waits until a row of a later one arrives, because only
    then it is whole.  Without it every batch must end with a whole poll.
    Rows of polls already taken in are late and go to ``<root>/late``.
    """
    keys, history = names(keys), StreamedHistory(root)
    # role: 'wait' a row held back, 'poll' (no keys, no value) the last poll taken in.
    pending = BatchState(f"{history.root}/pending")

    def run(batch: DataFrame, batch_id: int, hold: Hold) -> None:
        seen = batch.select(*keys, value, F.col(ts).alias("at"), F.lit("wait").alias("role"))
        held = pending.before(seen, batch_id)
        everything = seen if held is None else seen.unionByName(held)
        newest = everything.select(F.max("at")).scalar()
        done = everything.select(F.max(F.when(F.col("role") == "poll", F.col("at")))).scalar()
        waiting = everything.filter("role = 'wait'")
        late = F.coalesce(F.col("at") <= done, F.lit(False))
        _write_batch(waiting.filter(late).drop("role"), batch_id, f"{history.root}/late")
        whole = (F.col("at") < newest) if hold_newest else F.lit(True)
        taken = waiting.filter(~late & whole).drop("role")
        shape = taken.select(*keys, value, F.col("at").alias("valid_from"), F.col("at").alias("valid_to"))
        opened = history.open_rows.before(shape, batch_id)
        history.write(inventory_history(taken, keys, "at", value, opened, done), batch_id)
        polls = everything.filter(F.col("role") == "poll").select("at").unionByName(taken.select("at"))
        # Keys and value of the mark are null.
        mark = polls.agg(F.max("at").alias("at")).filter(F.col("at").isNotNull()).withColumn("role", F.lit("poll"))
        left = waiting.filter(~late & ~whole)
        pending.write(left.unionByName(mark, allowMissingColumns=True), batch_id)

    return _start(inventories, run, checkpoint, trigger)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
               each: Callable[[DataFrame, int], None] | None = None,
               trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Write a stream into a Parquet folder; by default what is available, then it ends.

    In update mode each batch overwrites its own folder ``batch_id=n``; the
    reader keeps the newest row per key.
    """
    if mode == "append" and each is None:
        writer = df.writeStream.format("parquet").option("path", path)
    else:
        writer = df.writeStream.foreachBatch(each or (lambda batch, batch_id: _write_batch(batch, batch_id, path)))
    return (writer.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
