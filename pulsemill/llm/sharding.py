"""Sharding by extendible hashing, with DataFrame functions only.

A directory maps hash prefixes to shards.  A bucket whose rows exceed the byte
limit splits on its next hash bit, and only such buckets do, until each fits.
Sums per prefix do the work: rows are summed once per round over ``ROUND_BITS``
further bits, and the depths between follow from those sums.  The first half
of the hash comes from the key, the second half from the row, so that a hot
key splits as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RESERVED, col, stored

#: Bits in a hash: half from the key, half from the row.
BITS = 60
#: Bits a round looks at; a round's table has 2 ** ROUND_BITS rows for each bucket it splits.
ROUND_BITS = 15

_CELL = RESERVED + "cell"


def _md5_bits(text, digits: int, skip: int = 0):
    return F.conv(F.substring(F.md5(text), 1 + skip, digits), 16, 10).cast("long")


def _hash(key, row):
    """30 bits of the key's MD5, then 30 bits of the row number's."""
    half = BITS // 2
    top = F.shiftright(_md5_bits(F.coalesce(key.cast("string"), F.lit("")), 8), 2)
    low = F.shiftright(_md5_bits(row.cast("string"), 8), 2)
    return F.shiftleft(top, half) + low


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory: depth, prefix, bytes, rows.  ``rows`` has hash and bytes.

    A leaf is the shallowest bucket that fits, holds a single row, or has no bit left.
    """
    leaves, base, open_rows = None, 0, rows
    while True:
        end = min(BITS, base + ROUND_BITS)
        cells = open_rows.groupBy(F.shiftright("hash", BITS - end).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        depths = F.sequence(F.lit(base if base == 0 else base + 1), F.lit(end))
        nodes = cells.withColumn("depth", F.explode(depths)).groupBy(
            "depth", F.expr(f"shiftright(cell, {end} - depth)").alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        nodes = stored(nodes, "directory")
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == BITS)
        split = nodes.filter(~fits)
        parents = split.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        found = nodes.filter(fits)
        first = found.filter(F.col("depth") == (0 if base == 0 else base + 1))
        deeper = found.filter(F.col("depth") > (0 if base == 0 else base + 1)).withColumn("above", F.shiftright("prefix", 1))
        deeper = deeper.join(parents, ["depth", "above"], "left_semi").drop("above")
        level = first.unionByName(deeper)
        leaves = level if leaves is None else leaves.unionByName(level)
        still = split.filter(F.col("depth") == end).select(F.col("prefix").alias("cell"))
        if end == BITS or still.isEmpty():
            return leaves
        open_rows = open_rows.withColumn("cell", F.shiftright("hash", BITS - end)).join(still, "cell", "left_semi").drop("cell")
        base = end


def assign_shards(docs: DataFrame, limit: int = 128 << 20, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of each row: key, shard, depth, bytes, shard_bytes, shard_rows.

    ``bytes`` is the text's UTF-8 length (null and empty: 0).  ``shard`` is
    the hash prefix in bits ("" while one shard holds all).  No shard is over
    ``limit`` bytes unless one row is: such a row has a shard of its own.
    Equal keys share a shard until it has to be split, then spread by row.
    Other columns of the input are left out, whatever their names; an empty
    table gives no rows.
    """
    rows = docs.select(col(key_col).alias("key"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("bytes"),
                       F.monotonically_increasing_id().alias("row"))
    rows = stored(rows.withColumn("hash", _hash(F.col("key"), F.col("row"))), "hashes")
    leaves = stored(directory(rows, limit), "leaves")
    # A leaf spans all hashes with its prefix: rows meet it at its own depth.
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # BITS + 1 values at most
    tried = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("hash", BITS - d).alias("prefix")) for d in sorted(depths)])
    if not depths:
        tried = F.array(F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    named = leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    return (rows.withColumn("at", F.explode(tried)).select("key", "bytes", "at.depth", "at.prefix")
            .join(named, ["depth", "prefix"])
            .select(F.col("key").alias(key_col), shard_name("depth", "prefix").alias("shard"), "depth", "bytes",
                    "shard_bytes", "shard_rows"))


def shard_name(depth: str, prefix: str):
    """The prefix in binary, as many digits as the depth."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN '' ELSE lpad(bin({prefix}), {depth}, '0') END")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key_col: str = "doc_id") -> None:
    """One folder and one file for each shard of uniquely keyed rows."""
    name = RESERVED + "shard"
    keyed = shards.select(col(key_col).alias(_CELL), F.concat(F.lit("s"), "shard").alias(name))
    (docs.join(keyed, col(key_col).eqNullSafe(F.col(_CELL))).drop(_CELL)
     .repartition(F.col(name)).write.partitionBy(name).parquet(path))
