"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into a ring of six segments.  If two fingerprints differ
in at most ``BUDGET`` = 2 bits, some segment starts a chain whose first l
segments differ in at most l * 2 / 6 bits, for every l.  So the first two
segments of the chain are equal, and the next three differ in one bit at
most, which leaves one half of their bits equal: the equal parts are join
keys, the rest of the chain prunes what they bring together, and the full
Hamming check ends it.

Only different fingerprints are compared.  Buckets of up to ``CAP``
fingerprints are compared in pairs.  Fingerprints of larger buckets are linked
through the 65 values within one bit of each: two are within two bits exactly
if they share such a value, and at most 65 fingerprints share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RESERVED, col, map_texts, narrow, stored, with_row_id
from .components import components

BITS = 64
BUDGET = 2
#: Segment borders of the ring, from the lowest bit.
BORDERS = (0, 11, 22, 32, 43, 54, 64)
SEGMENTS = len(BORDERS) - 1
CAP = 64

_WEIGHT = 1 << 16  # shingles whose bits are counted at a time


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """SimHash of each text as int64: a bit is 1 if it is set in over half of the shingles' hashes.

    A-Z are lower-cased; words are runs of characters other than white space;
    a text with fewer words than a shingle is one shingle, one without words
    has fingerprint zero.
    """
    out = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        parts = text.encode("utf-8", "replace").lower().split() if text else []
        if not parts:
            continue
        joined = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        width = min(words, len(parts))
        starts = [0, *(ends[:-1] + 1).tolist()]
        stops = ends[width - 1:].tolist()
        votes, total = np.zeros(BITS, np.int64), len(stops)
        for k in range(0, total, _WEIGHT):
            h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[k:k + _WEIGHT], stops[k:k + _WEIGHT])], np.uint64)
            votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(votes * 2 > total, bitorder="little").view("<i8")[0]
    return out


def _mask(segments: Iterator[int]) -> int:
    return sum(((1 << BORDERS[s + 1]) - (1 << BORDERS[s])) for s in segments)


def chain_keys() -> list[int]:
    """For each start of a chain, the two masks of which one must be equal: segments 1 and 2, and half of the bits of 3 to 5."""
    masks = []
    for start in range(SEGMENTS):
        ring = [(start + k) % SEGMENTS for k in range(SEGMENTS)]
        exact = _mask(ring[:2])
        loose = [b for s in ring[2:5] for b in range(BORDERS[s], BORDERS[s + 1])]
        for half in (loose[:16], loose[16:]):
            masks.append(exact | sum(1 << b for b in half))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def on_ring(diff: np.ndarray) -> np.ndarray:
    """Whether some chain keeps to its proportional budgets, for XORs of fingerprints."""
    parts = np.stack([np.bitwise_count(diff & np.uint64(_mask([s]))).astype(np.int8) for s in range(SEGMENTS)])
    found = np.zeros(len(diff), bool)
    for start in range(SEGMENTS):
        total, kept = np.zeros(len(diff), np.int8), np.ones(len(diff), bool)
        for k in range(SEGMENTS):
            total = total + parts[(start + k) % SEGMENTS]
            kept &= total <= (k + 1) * BUDGET // SEGMENTS
        found |= kept
    return found


def _close_pairs(fp: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget among rows of the same run; rows are sorted by run."""
    left, right, d = [], [], 1
    while d < len(fp) and (same := np.flatnonzero(run[d:] == run[:-d])).size:
        diff = (fp[same] ^ fp[same + d]).view(np.uint64)
        same = same[on_ring(diff)]
        diff = (fp[same] ^ fp[same + d]).view(np.uint64)
        same = same[np.bitwise_count(diff) <= BUDGET]
        left.append(fp[same])
        right.append(fp[same + d])
        d += 1
    if not left:
        return fp[:0], fp[:0]
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of small buckets, and (a, null) for each member of a larger one.

    Rows come sorted by (mask, key).  At most the last CAP rows of a batch
    wait for the next one, so a bucket of any size streams through.
    """
    kept: list[np.ndarray] = []
    hot: tuple | None = None  # the large bucket that the last batch ended in

    def settle(mask, key, fp, final: bool):
        nonlocal hot
        new = np.ones(len(fp), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(new) - 1
        size = np.bincount(run, minlength=1)
        large = size > CAP
        if hot is not None and len(fp) and (mask[0], key[0]) == hot:
            large[0] = True
        last = (mask[-1], key[-1]) if len(fp) else hot
        wait = np.zeros(len(fp), bool)
        if len(fp) and not final and not large[run[-1]]:
            wait = run == run[-1]
        hot = last if len(fp) and large[run[-1]] else None
        many = large[run]
        a, b = _close_pairs(fp[~many & ~wait], run[~many & ~wait])
        every = np.concatenate([a, fp[many]])
        other = pa.array(np.concatenate([b, fp[many]]), pa.int64(), mask=np.arange(len(every)) >= len(a))
        return (mask[wait], key[wait], fp[wait]), pa.RecordBatch.from_arrays([pa.array(every, pa.int64()), other], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if kept:
            cols = [np.concatenate([k, c]) for k, c in zip(kept, cols)]
        kept, out = settle(*cols, final=False)
        yield out
    if kept:
        yield settle(*kept, final=True)[1]


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Links a, b that connect all of ``fps`` (one column fp, without repeats) within the budget.

    Every link is real; of a large bucket there are as many as connect it, not all.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(chain_keys())])
    keyed = fps.withColumn("k", F.explode(keys)).select("k.mask", "k.key", "fp")
    found = stored(keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")
                   .mapInArrow(_bucket_links, "a long, b long"), "links")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    ball = (found.filter("b is null").select(F.col("a").alias("fp")).distinct()
            .withColumn("z", F.explode(near)).groupBy("z").agg(F.collect_set("fp").alias("all"))  # 65 members at most
            .filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b"))
    return found.filter("b is not null").unionByName(ball.select("a", "b")).distinct()


def classes(fps: DataFrame) -> DataFrame:
    """fp and root: the class of each fingerprint that is linked with another."""
    return components(link_fingerprints(fps)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Class of each row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and are linked like any other.
    Null ids are never the smallest unless a class has no other.  Repeated
    rows are rows of their own.  Other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = stored(_with_fingerprint(narrow(docs, id=id_col, text=text_col), words), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first"))
    root = stored(_rooted(rows.select("fp").distinct()), "roots")
    of_root = firsts.join(root, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(root.join(of_root, "root").select("fp", "component_id"), "fp").select(
        F.col("id").cast(kind).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(fps: DataFrame) -> DataFrame:
    """fp and root for every fingerprint; one without links is its own root."""
    return fps.join(classes(fps), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _with_fingerprint(rows: DataFrame, words: int) -> DataFrame:
    """id and fp of (id, text)."""
    kind = dict(rows.dtypes)["id"]
    return map_texts(rows, "text", f"id {kind}, fp long",
                     lambda texts, batch: {"id": batch.column(batch.schema.get_field_index("id")), "fp": fingerprints(texts, words)})


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row of each class: that with the smallest id (null ids last), one of them if several are equal.

    All columns stay.
    """
    row = RESERVED + "row"
    numbered = stored(with_row_id(docs, row), "numbered")
    # The row number travels as the id; the true id only ranks.
    keyed = numbered.select(F.struct(col(id_col).isNull().alias("no_id"), col(id_col).alias("id"), F.col(row).alias("row")).alias("id"),
                            col(text_col).alias("text"))
    rows = stored(_with_fingerprint(keyed, words), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first"))
    root = _rooted(firsts.select("fp"))
    kept = firsts.join(root, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
