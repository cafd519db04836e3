"""Phrase collocation mining with counting quotient filters.

1. Texts become blocks of one language: a dictionary of the block's words and
   a row of codes.  The dictionaries meet by word; a word seen often enough
   gets an id as soon as its count says so, and the blocks learn the ids of
   their words.  A phrase can only be frequent if all its words are.
2. Tasks count n-grams of ids in quotient filters and send them in slices by
   their leading quotient bits; the filters of a slice merge by adding.
   Counts are exact.  Longer phrases are counted where all their pairs may
   be frequent, which a bit array of fixed size says without false noes.
3. Candidates look up the counts of their parts, lose to longer phrases of the
   same count, and are ranked by their lowest-scoring cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, map_texts, narrow, stored
from .quotient import decoded, encoded, limb_bits, packed, permuted, restored, summed, unpacked

LONGEST = 5
#: Characters of a block, and n-grams that a task holds before it sends its filters.
BLOCK, HELD = 1 << 22, 1 << 21
#: n-grams of one slice over all filters, about.
SLICE = 1 << 20
#: Bits of the array that knows the frequent pairs: 8 MB, whatever the input.
PAIR_BITS = 26
#: Copies of one-word counts, over which the look-ups of a common word spread.
SPREAD = 16

_CUTS = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n" * 10 + b" ")


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, with a newline for each border of pieces."""
    return [w for w in text.encode("utf-8", "replace").lower().translate(_CUTS).replace(b"\n", b" \n ").split(b" ") if w]


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (lang, text): id, lang, tokens, words, their counts, and codes (place in words plus 1; 0 is a border)."""
    at = docs.columns.index("lang")

    def work(texts, batch):
        langs = batch.column(at).to_pylist()
        of: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            of.setdefault(lang, []).append(i)
        out = {k: [] for k in ("block", "lang", "tokens", "words", "counts", "codes")}
        for lang, rows in of.items():
            words: list[bytes] = []
            for i in rows:
                words += words_of(texts[i] or "")
                words.append(b"\n")
            counts = Counter(words)
            counts.pop(b"\n")
            if not counts:
                continue
            place = {w: k for k, w in enumerate(counts, 1)}
            place[b"\n"] = 0
            work.number += 1
            out["block"].append((TaskContext.get().partitionId() << 33) + work.number)
            out["lang"].append(lang)
            out["tokens"].append(sum(counts.values()))
            out["words"].append([w.decode() for w in counts])
            out["counts"].append(list(counts.values()))
            out["codes"].append(np.fromiter(map(place.__getitem__, words), "<u4", len(words)).tobytes())
        return out

    work.number = 0
    return map_texts(docs, "text", "block long, lang string, tokens long, words array<string>, counts array<long>, codes binary", work, BLOCK)


def _named(least: int, parts: int):
    """Ids of frequent words, from (lang, word, block, place, count) sorted by lang and word.

    Rows (block, places, ids) for the blocks that have them, put together for up to
    HELD places, and one row (lang, word, id, count) for each word.  Fewer than ``least`` rows
    of a word wait until its count suffices; the others pass at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, given = TaskContext.get().partitionId(), 0
        kept: pa.Table | None = None  # rows of a word that is not frequent yet
        open_: list | None = None  # lang, word, id and count of a frequent word that may go on

        held: list[tuple] = []  # block, place, id of replies not sent yet

        def spelled(ends):
            k = len(ends)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int64())), pa.array([e[0] for e in ends], pa.string()),
                 pa.array([e[1] for e in ends], pa.string()), pa.array([e[2] for e in ends], pa.int64()), pa.array([e[3] for e in ends], pa.int64())],
                names=["block", "places", "ids", "lang", "word", "id", "count"])

        def replies():
            block, place, ident = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            order = np.argsort(block, kind="stable")
            block = block[order]
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
            ends = pa.array([*start.tolist(), len(block)], pa.int32())
            k = len(start)
            return pa.RecordBatch.from_arrays(
                [pa.array(block[start], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(place[order], pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(ident[order], pa.int64())), *[pa.nulls(k, t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]],
                names=["block", "places", "ids", "lang", "word", "id", "count"])

        def settle(table: pa.Table, final: bool):
            nonlocal kept, open_, given
            lang, word = (table.column(c).combine_chunks() for c in ("lang", "word"))
            block, place, count = (table.column(c).to_numpy() for c in ("block", "place", "count"))
            n = len(block)
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(word[1:], word[:-1])).to_numpy(zero_copy_only=False)
            start, run = np.flatnonzero(new), np.cumsum(new) - 1
            total = np.add.reduceat(count, start)
            ends = []
            goes_on = open_ is not None and lang[0].as_py() == open_[0] and word[0].as_py() == open_[1]
            if open_ is not None and not goes_on:
                ends.append(tuple(open_))
                open_ = None
            frequent = total >= least
            if goes_on:
                frequent[0] = True
            ids = np.zeros(len(start), np.int64)
            fresh = frequent.copy()
            if goes_on:
                fresh[0], ids[0] = False, open_[2]
            ids[fresh] = (given + np.arange(fresh.sum())) * parts + mine + 1
            given += int(fresh.sum())
            for r in np.flatnonzero(frequent):
                first = int(start[r])
                entry = open_ if goes_on and r == 0 else [lang[first].as_py(), word[first].as_py(), int(ids[r]), 0]
                entry[3] += int(total[r])
                if r == len(start) - 1 and not final:
                    open_ = entry
                else:
                    ends.append(tuple(entry))
                    if entry is open_:
                        open_ = None
            use = frequent[run]
            kept = table.slice(int(start[-1])) if not final and not frequent[-1] else None
            held.append((block[use], place[use], ids[run][use]))
            return spelled(ends)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table])
            if table.num_rows:
                yield settle(table, False)
                if sum(len(h[0]) for h in held) >= HELD:
                    yield replies()
        if kept is not None:
            yield settle(kept, True)
        if open_ is not None:
            yield spelled([tuple(open_)])
        if held:
            yield replies()

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and codes of blocks with the ids of frequent words; other words and borders are 0."""
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        out = []
        for i in range(batch.num_rows):
            codes = np.frombuffer(at["codes"][i].as_buffer(), "<u4")
            table = np.zeros(at["size"][i].as_py() + 1, np.int64)
            table[at["places"][i].values.to_numpy() + 1] = at["ids"][i].values.to_numpy()
            ids = table[codes]
            edge = (ids > 0) | np.append(True, ids[:-1] > 0)  # runs of zeros say no more than one
            out.append(ids[edge].astype("<i8" if ids.max(initial=0) >> 32 else "<u4"))
        yield pa.RecordBatch.from_arrays(
            [at["lang"], pa.array([x.itemsize for x in out], pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())],
            names=["lang", "bytes", "codes"])


def _pair_place(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    h = (first * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (second * np.uint64(0x9E3779B97F4A7C15))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _filters(lengths: range, width: int, skip: int, pairs):
    """Slices of quotient filters: lang, length, slice, filter.  ``pairs`` (a broadcast bit array) may rule n-grams out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        total = 0
        known = np.frombuffer(pairs.value, np.uint8) if pairs is not None else None

        def sent():
            out = {k: [] for k in ("lang", "length", "slice", "filter")}
            for (lang, m), parts in held.items():
                bits = limb_bits(m * width)
                limbs, counts = summed([np.concatenate([p[0][k] for p in parts]) for k in range(len(bits))], np.concatenate([p[1] for p in parts]))
                cut = min(skip, bits[0])
                heads = (limbs[0] >> np.uint64(bits[0] - cut)).astype(np.int64) if cut else np.zeros(len(counts), np.int64)
                where, start = np.unique(heads, return_index=True)
                for head, a, b in zip(where, start, [*start[1:], len(heads)]):
                    out["lang"].append(lang)
                    out["length"].append(m)
                    out["slice"].append(int(head))
                    out["filter"].append(encoded([x[a:b] for x in limbs], counts[a:b], bits, cut))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["length"], pa.int32()),
                                               pa.array(out["slice"], pa.int64()), pa.array(out["filter"], pa.binary())], names=list(out))

        for batch in batches:
            for lang, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                every = np.frombuffer(data.as_buffer(), "<u4" if size == 4 else "<i8").astype(np.uint64)
                for at in range(0, len(every), HELD):
                    ids = every[at:at + HELD + LONGEST - 1]
                    own = min(HELD, len(every) - at)  # n-grams that begin here
                    good = ids > 0
                    if known is not None and len(ids) > 1:
                        place = _pair_place(ids[:-1], ids[1:], len(known).bit_length() + 2)
                        both = good[:-1] & good[1:] & (known[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0)
                    else:
                        both = good[:-1] & good[1:]
                    for m in lengths:
                        if len(ids) < m:
                            continue
                        ok = both[:len(ids) - m + 1].copy()
                        for k in range(1, m - 1):
                            ok &= both[k:len(ids) - m + 1 + k]
                        starts = np.flatnonzero(ok)
                        starts = starts[starts < own]
                        if len(starts):
                            bits = limb_bits(m * width)
                            limbs = permuted(packed([ids[starts + k] for k in range(m)], width), bits)
                            held.setdefault((lang, m), []).append(summed(limbs, np.ones(len(starts), np.int64)))
                            total += len(starts)
                    if total >= HELD:
                        yield sent()
                        total = 0
        if held:
            yield sent()

    return run


def _merged(width: int, skip: int, least: int):
    """The frequent n-grams of one slice of all filters: lang, ids, f."""

    def run(table: pa.Table) -> pa.Table:
        lang, m, head = (table.column(c)[0].as_py() for c in ("lang", "length", "slice"))
        bits = limb_bits(m * width)
        parts = [decoded(x.as_buffer(), bits, min(skip, bits[0]), head) for x in table.column("filter")]
        limbs, counts = summed([np.concatenate([p[0][k] for p in parts]) for k in range(len(bits))], np.concatenate([p[1] for p in parts]))
        use = counts >= least
        ids = np.stack(unpacked(restored([x[use] for x in limbs], bits), m, width), axis=1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * m), pa.array(ids.reshape(-1)))
        return pa.table({"lang": pa.array([lang] * len(ids), pa.string()), "ids": lists, "f": pa.array(counts[use])})

    return run


def _counted(coded: DataFrame, lengths: range, width: int, skip: int, least: int, pairs, label: str) -> DataFrame:
    slices = coded.mapInArrow(_filters(lengths, width, skip, pairs), "lang string, length int, slice long, filter binary")
    return stored(slices.groupBy("lang", "length", "slice").applyInArrow(_merged(width, skip, least), "lang string, ids array<long>, f long"), label)


def _pair_bits(pairs: DataFrame) -> bytes:
    """Bit array of the frequent pairs: 2 ** PAIR_BITS bits, of which Spark sends those that are set."""

    def places(batches):
        for batch in batches:
            ids = batch.column(0).values.to_numpy().astype(np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_pair_place(ids[:, 0], ids[:, 1], PAIR_BITS))], names=["place"])

    rows = (pairs.select("ids").mapInArrow(places, "place long").distinct()
            .groupBy(F.shiftright("place", 15).alias("part")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit((1 << 15) - 1)).cast("int")).alias("bits")))

    def chunks(batches):
        for batch in batches:
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                flags = np.zeros(1 << 15, np.uint8)
                flags[bits.values.to_numpy()] = 1
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()])], names=["part", "bits"])

    out = bytearray(1 << (PAIR_BITS - 3))
    for part, bits in rows.mapInArrow(chunks, "part long, bits binary").toLocalIterator():  # 2^11 rows at most
        out[part << 12:(part + 1) << 12] = bits
    return bytes(out)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """l, r and score of the lowest cut, in whole numbers of any size."""
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        best = []
        for a, n, parts in zip(at["a"].to_pylist(), at["n"].to_pylist(), at["parts"].to_pylist()):
            by = {(p["k"], p["head"]): p["f"] for p in parts}
            best.append(min((1000 * a * n // (by[k, True] * by[k, False]), k, by[k, True], by[k, False]) for k, head in by if head))
        yield pa.RecordBatch.from_arrays(
            [*[at[c] for c in ("lang", "ids", "a", "n")], *[pa.array([b[i] for b in best], pa.int64()) for i in (2, 3, 0)]],
            names=["lang", "ids", "a", "n", "l", "r", "score"])


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of words (lang, id, word, f) and phrases (lang, ids, f) that occur ``least`` times, and words in all (lang, n).

    Nulls of the language are ``und``, null texts are empty.
    """
    rows = narrow(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    blocks = stored(_blocks(rows), "blocks")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    sorted_ = entries.select("lang", F.col("w.words").alias("word"), "block", "place", F.col("w.counts").alias("count")).repartition(
        parts, "lang", "word").sortWithinPartitions("lang", "word")
    # On a cluster that deals to more partitions than asked for, ids stay apart because the step covers them.
    step = max(parts, sorted_.rdd.getNumPartitions())
    named = stored(sorted_.mapInArrow(_named(least, step), "block long, places array<int>, ids array<long>, lang string, word string, id long, count long"), "named")
    words = named.filter("block is null").select("lang", "id", "word", F.col("count").alias("f"))
    known = named.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("places", "ids")).alias("known"))  # words of one block
    known = known.select("block", F.flatten("known.places").alias("places"), F.flatten("known.ids").alias("ids"))
    coded = stored(blocks.join(known, "block").select("lang", F.size("words").alias("size"), "codes", "places", "ids").mapInArrow(
        _coded, "lang string, bytes int, codes binary"), "coded")
    sizes = stored(blocks.groupBy("lang").agg(F.sum("tokens").alias("n")), "sizes")
    words = stored(words, "words")
    top = words.agg(F.max("id")).first()[0] or 1
    total = sizes.agg(F.sum("n")).first()[0] or 1
    drop_stored(spark, blocks, named)
    width, skip = int(top).bit_length(), max(0, (total // SLICE).bit_length())
    two = _counted(coded, range(2, 3), width, skip, least, None, "pairs")
    pairs = spark.sparkContext.broadcast(_pair_bits(two))
    more = _counted(coded, range(3, LONGEST + 1), width, skip, least, pairs, "phrases")
    drop_stored(spark, coded)
    return words, two.unionByName(more), sizes


def mine_collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at ``[.,;:!?]`` and line ends into pieces, and those at
    blanks and tabs into words, A-Z lower-cased.  Phrases of 2 to 5 words
    within a piece that occur ``a >= least`` times are candidates; one goes
    if it lies inside a longer one that occurs as often.  Its score is
    the lowest ``1000 * a * n // (l * r)`` of its cuts into two parts, of
    equal ones that after the fewest words.  Ranks go by score, count and phrase (UTF-8 order).  A
    null language is ``und``, a null text is empty, repeated rows count
    each; other columns don't matter; an empty table gives an empty result.
    """
    words, phrases, sizes = frequent_phrases(docs, lang_col, text_col, least)
    longer = phrases.filter(F.size("ids") > 2)
    inside = longer.select("lang", F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), "f")
    # Counts only fall with length, so the phrase one word longer decides.
    inside = inside.groupBy("lang", "ids").agg(F.max("f").alias("longer"))
    kept = phrases.join(inside, ["lang", "ids"], "left").filter("longer is null or longer < f").select("lang", "ids", F.col("f").alias("a"))

    cuts = kept.select("lang", "ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    looks = cuts.select("lang", "ids", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("head"), F.expr("slice(ids, 1, k)").alias("part")),
        F.struct(F.lit(False).alias("head"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("part")))).alias("p"))
    looks = looks.select("lang", "ids", "a", "k", "p.head", "p.part",
                         F.when(F.size("p.part") == 1, F.pmod(F.xxhash64("ids"), F.lit(SPREAD))).otherwise(0).cast("int").alias("copy"))
    single = words.select("lang", F.array("id").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("copy"))
    counts = single.unionByName(phrases.select("lang", F.col("ids").alias("part"), "f", F.lit(0).alias("copy")))
    found = looks.join(counts, ["lang", "part", "copy"]).groupBy("lang", "ids", "a").agg(F.collect_list(F.struct("k", "head", "f")).alias("parts"))  # 8 at most
    scored = found.join(F.broadcast(sizes), "lang").select("lang", "ids", "a", "n", "parts").mapInArrow(
        _scored, "lang string, ids array<long>, a long, n long, l long, r long, score long")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = stored(scored.withColumn("place", F.rank().over(best)).filter(F.col("place") <= most).drop("place"), "first")  # ties at the end stay
    spelled = (first.select("lang", "ids", F.posexplode("ids").alias("i", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
               .groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (first.join(spelled, ["lang", "ids"]).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
