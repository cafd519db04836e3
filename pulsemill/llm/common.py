"""What the operators share: row ids, scratch tables, Arrow maps over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill.session import scratch_dir

#: Names of helper columns start with this, so that columns of the input never clash.
RESERVED = "pulsemill_"


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under the operator's own names."""
    return df.select(*[col(old).alias(new) for new, old in columns.items()])


#: Spark's setting that removes the shuffle files of a plan at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    Cuts the lineage: a lost executor costs a reread of the table, not of the
    plan behind it.  So the plan's shuffle files go as soon as it is written.
    """
    spark = df.sparkSession
    path, before = scratch_dir(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_id(df: DataFrame, name: str = RESERVED + "row") -> DataFrame:
    """A number for each row of one reading: another reading may split the files otherwise and number them anew.

    Where numbers join rows back, write them once: ``stored(with_row_id(df))``.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def blocks(texts: list[str | None], chars: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``chars`` characters, one row at least."""
    start = total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if total and total + n > chars:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, text_col: str, schema: str,
              work: Callable[[list[str | None], pa.RecordBatch], dict[str, object]],
              chars: int = 1 << 18) -> DataFrame:
    """Apply ``work`` to runs of rows; it returns the output columns by name.

    ``work`` gets the texts (None for null) and the run's Arrow batch.  Runs
    hold about ``chars`` characters, so memory follows the longest text and
    not the batch size.
    """
    empty = df.sparkSession.createDataFrame([], schema)
    arrow = _arrow_schema(empty)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in blocks(texts, chars):
                got = work(texts[a:b], batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [_as(got[f.name], f.type) for f in arrow],
                    schema=arrow)

    return df.mapInArrow(run, empty.schema)


def filter_texts(df: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """Rows for whose text ``keep`` says True; all columns pass through as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, mask = batch.column(at).to_pylist(), []
            for a, b in blocks(texts):
                mask += [bool(x) for x in keep(texts[a:b])]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    """An Arrow array of this type from one, or from Python or numpy values."""
    if not isinstance(values, pa.Array):
        return pa.array(values, kind)
    return values if values.type == kind else values.cast(kind)
