"""Event files that are read on from where the last run stopped (inventory A6)."""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunked import newest_per_group
from ..session import scratch_dir
from .snapshots import _struct, conform

#: Every so many batches the index of files is written whole; in between only what changed.
WHOLE_INDEX = 32
_INDEX = "file string, bytes bigint, changed timestamp, taken bigint, batch bigint"


def event_file_stream(spark: SparkSession, path: str, schema="xml_events", fmt: str = "parquet",
                      max_files: int | None = None, **options) -> DataFrame:
    """New files of a folder as a stream; the checkpoint remembers the files read, not how far."""
    reader = spark.readStream.schema(_struct(schema)).format(fmt).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


class GrowingFiles:
    """Files that gain rows at their end, each row taken once.

    An index says how many rows of each file have been taken.  A step lists
    the folder, reads the files whose size or time has changed, skips the
    rows taken before and writes the others to ``<out>/batch=n``; then the
    index, then the commit.  A step without a commit is done anew over what
    it has left, so a crash at any point changes nothing.  Files that have
    not changed are not read.

    A file that has become smaller is another file of that name and counts
    from its start.  In text formats (JSON lines, CSV) a last line that does
    not parse waits: it may still be written to.
    """

    def __init__(self, spark: SparkSession, path: str, out: str, checkpoint: str, schema="xml_events", fmt: str = "parquet",
                 max_files: int | None = None, **options):
        self.spark, self.path, self.out, self.root = spark, path, out.rstrip("/"), checkpoint.rstrip("/")
        self.schema, self.fmt, self.max_files, self.options = _struct(schema), fmt, max_files or 10_000, options

    def committed(self) -> int:
        """The number of committed batches."""
        return self._commits().agg(F.count(F.lit(1))).first()[0]

    def _there(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _commits(self) -> DataFrame:
        if not self._there(f"{self.root}/commits"):
            return self.spark.createDataFrame([], "batch bigint")
        return self.spark.read.schema("batch bigint").parquet(f"{self.root}/commits")

    def _index(self, n: int) -> DataFrame:
        """file, bytes, changed and rows taken, as of batch n - 1."""
        if n == 0:
            return self.spark.createDataFrame([], _INDEX)
        parts = [f"{self.root}/index/batch={i}" for i in range((n - 1) // WHOLE_INDEX * WHOLE_INDEX, n)]
        return newest_per_group(self.spark.read.schema(_INDEX).parquet(*parts), "file", "batch")

    def _listed(self) -> DataFrame:
        """The files there are; their content is not read."""
        glob = {k: v for k, v in self.options.items() if k in ("pathGlobFilter", "recursiveFileLookup")}
        files = self.spark.read.format("binaryFile").options(**glob).load(self.path)
        return files.select(F.col("_metadata.file_path").alias("file"), F.col("path"), F.col("length").alias("bytes"),
                            F.col("modificationTime").alias("changed"))

    def _placed(self, paths: list[str]) -> DataFrame:
        """Rows of some files with file and position in it (from 0)."""
        reader = self.spark.read.options(**self.options)
        if self.fmt == "parquet":
            rows = reader.schema(self.schema).parquet(*paths)
            return rows.select(*rows.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"), F.lit(False).alias("_bad"))
        text = self.fmt in ("json", "csv")
        rows = reader.text(paths) if text else reader.schema(self.schema).format(self.fmt).load(paths)
        split = rows.select(*rows.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
                            F.monotonically_increasing_id().alias("_id"))
        # Written once: a second reading of a file that grows would see other rows.
        path = scratch_dir(self.spark, "event-files")
        split.write.parquet(path)
        rows = self.spark.read.schema(split.schema).parquet(path)
        parts = rows.groupBy("_file", "_from").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        # A file's parts are as many as its splits.
        earlier = F.sum("_rows").over(Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.select("_file", "_from", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
        rows = rows.join(F.broadcast(parts), ["_file", "_from"]).withColumn("_at", F.col("_before") + F.col("_id") - F.col("_first"))
        if not text:
            return rows.withColumn("_bad", F.lit(False))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema) + ", `_corrupt_record` string"
        parse = F.from_json if self.fmt == "json" else F.from_csv
        parsed = rows.filter(F.trim("value") != "").withColumn("_r", parse("value", ddl, {"mode": "PERMISSIVE"}))
        return parsed.select("_r.*", "_file", "_at").withColumn("_bad", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")

    def advance(self) -> int:
        """Take what has arrived; the number of batches written."""
        n = first = self.committed()
        while True:
            index = self._index(n)
            known = index.select(F.col("file").alias("_f"), F.col("bytes").alias("_b"), F.col("changed").alias("_c"), "taken")
            seen = self._listed().join(known, F.col("file") == F.col("_f"), "left")
            news = seen.filter("_f is null or bytes <> _b or changed <> _c")
            some = news.orderBy("changed", "file").limit(self.max_files).collect()  # max_files rows
            if not some:
                return n - first
            # Smaller than before: another file of that name.
            state = self.spark.createDataFrame(
                [(r.file, r.bytes, r.changed, 0 if r.taken is None or r.bytes < r._b else r.taken) for r in some],
                "_file string, _bytes bigint, _changed timestamp, _taken bigint")
            rows = self._placed([r.path for r in some])
            last = rows.groupBy("_file").agg(F.max("_at").alias("_last"))
            rows = rows.join(F.broadcast(last), "_file").filter(~(F.col("_bad") & (F.col("_at") == F.col("_last"))))
            fresh = rows.join(F.broadcast(state), "_file").filter("_at >= _taken")
            fields = [f.name for f in self.schema]
            fresh.select(*fields, F.col("_file").alias("_event_file"), F.col("_at").alias("_event_at")).write.mode("overwrite").parquet(f"{self.out}/batch={n}")
            written = self.spark.read.schema("_event_file string, _event_at bigint").parquet(f"{self.out}/batch={n}")
            ends = written.groupBy(F.col("_event_file").alias("_file")).agg((F.max("_event_at") + 1).alias("_end"))
            changed = (state.join(ends, "_file", "left")
                       .select(F.col("_file").alias("file"), F.col("_bytes").alias("bytes"), F.col("_changed").alias("changed"),
                               F.coalesce("_end", "_taken").alias("taken"), F.lit(n).cast("bigint").alias("batch")))
            if n % WHOLE_INDEX == 0:
                changed = changed.unionByName(index.join(changed.select("file"), "file", "left_anti"))
            changed.coalesce(8).write.mode("overwrite").parquet(f"{self.root}/index/batch={n}")
            self.spark.range(n, n + 1).select(F.col("id").alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
            n += 1

    def read(self) -> DataFrame:
        """The rows of the committed batches."""
        n = self.committed()
        if n == 0:
            return self.spark.createDataFrame([], self.schema)
        return conform(self.spark.read.schema(self.schema).parquet(*[f"{self.out}/batch={i}" for i in range(n)]), self.schema)


class Done:
    """What a run that has ended says; it has the methods of a query that callers wait on."""

    isActive = False

    def __init__(self, batches: int):
        self.batches = batches

    def awaitTermination(self, timeout: float | None = None) -> bool:
        return True

    def stop(self) -> None:
        return None


def resume_event_files(spark: SparkSession, path: str, out: str, checkpoint: str, schema="xml_events",
                       fmt: str = "parquet", max_files: int | None = None, trigger: Mapping[str, object] | None = None,
                       **options) -> StreamingQuery | Done:
    """Append what arrived since the last call to ``out``: new files, and new rows of files that have grown.

    Without ``trigger`` one run takes what is there.  With one, such as
    ``{"processingTime": "1 minute"}``, a query polls until it is stopped.
    """
    files = GrowingFiles(spark, path, out, checkpoint, schema, fmt, max_files, **options)
    if trigger is None:
        return Done(files.advance())
    busy = threading.Lock()

    def poll(batch: DataFrame, batch_id: int) -> None:
        with busy:
            files.advance()

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream.foreachBatch(poll).option("checkpointLocation", f"{checkpoint.rstrip('/')}/ticks").trigger(**trigger).start())
