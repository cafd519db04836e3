"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries find the digests that may be frequent; an exact count
verifies them and picks their winners.  The winners are at most
``counters + 1`` rows, so they are broadcast and settle their copies in the
tasks that read them.  All other digests go through an ordinary shuffle, in
which no group can be larger than rows / (counters + 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored

#: Characters that do not count when texts are compared.
WHITE = r"[\x20\x09-\x0D]+"


def digest_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, ""), 256)


def _reduced(counts: dict[str, int], counters: int) -> dict[str, int]:
    """Misra-Gries merge step: take the (counters + 1)-th count from all and drop what is used up."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def frequent_digests(digests: DataFrame, counters: int = 1024) -> DataFrame:
    """Candidates (digest): every digest on more than 1/(counters + 1) of the rows, ``counters + 1`` rows at most.

    ``digests`` has one string column ``digest``.  Each task sums up its rows
    in ``counters`` counters; sums of summaries keep the guarantee.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                counts[pair["values"]] = counts.get(pair["values"], 0) + pair["counts"]
            if len(counts) > 16 * counters:
                counts = _reduced(counts, counters)
        counts = _reduced(counts, counters)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(counts.keys(), pa.string()),
                                          "n": pa.array(counts.values(), pa.int64())})

    parts = digests.select("digest").mapInArrow(summarise, "digest string, n long")
    return (parts.groupBy("digest").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "digest").limit(counters + 1).select("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """Class of equal texts of each row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree without white space.  The row with the
    most code points stays; ties go to the smallest id, null ids last, and
    among repeated rows to one of them.  A null text is an empty one.  The
    output has a row for each input row and none of its other columns, so
    their names don't matter; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = stored(docs.select(
        col(id_col).alias("id"), F.coalesce(F.length(col(text_col)), F.lit(0)).alias("size"),
        digest_of(col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    rank = F.struct((-F.col("size")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "row")
    classes = [F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best")]

    found = F.broadcast(frequent_digests(rows, counters))
    heavy = (rows.join(found, "digest").groupBy("digest").agg(*classes)
             .filter(F.col("group_size") * (counters + 1) > rows.count()))
    heavy = F.broadcast(stored(heavy, "frequent"))
    settled = rows.join(heavy, "digest")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti")
    rest = rest.join(rest.groupBy("digest").agg(*classes), "digest")
    return settled.unionByName(rest).select(
        F.col("id").cast(kind).alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"))


