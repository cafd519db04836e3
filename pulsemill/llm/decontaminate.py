"""Benchmark decontamination by the q-gram lemma.

A passage of n characters that appears with at most e edits shares at least
n - q + 1 - q * e of its q-grams, all within e + 1 neighbouring diagonals.
Texts are scanned for the benchmark's q-grams; hits are counted in bands of
diagonals twice that wide that overlap by half, so that some band holds all
of a passage.  Bands over the bound are regions, verified by a banded
alignment.  All work on a text is local to its row: no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, map_texts, narrow

Q = 8
SPACE = 0
_BASE = np.uint32(0x01000193)
_SLOTS = 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: its lower case if a letter or digit, else SPACE."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LN":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, the code point each came from, and bounds by text.

    Letters and digits are lower-cased, runs of anything else are one SPACE,
    and a text starts and ends without one.
    """
    texts = [t or "" for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    codes = _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != SPACE
    if len(codes):
        # A space stays where the character before it is a letter of the same text; trailing ones go below.
        before = np.concatenate([[False], keep[:-1]])
        before[starts[starts < len(codes)]] = False
        keep = keep | before
    kept = np.concatenate([[0], np.cumsum(keep)])
    bounds = kept[np.concatenate([[0], ends])]
    at = np.flatnonzero(keep)
    out = codes[at]
    last = bounds[1:][(np.diff(bounds) > 0)] - 1
    trailing = last[out[last] == SPACE]
    if len(trailing):
        gone = np.zeros(len(out), bool)
        gone[trailing] = True
        bounds = bounds - np.concatenate([[0], np.cumsum(gone)])[bounds]
        out, at = out[~gone], at[~gone]
    return out, at - np.repeat(starts, np.diff(bounds)), bounds


def qgram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 codes from each position, by doubling."""
    h, power = codes.astype(np.uint32), _BASE
    for width in (1, 2, 4):
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * power + h[width:]
        power = np.uint32(int(power) ** 2 & 0xFFFFFFFF)
    return h


def edit_budget(n: int, rate: float) -> int:
    """Edits allowed in n codes; the lemma needs one q-gram left to see."""
    return max(0, min(int(rate * n), (n - Q) // Q))


@dataclass
class Probe:
    """The q-grams of a block of passages."""

    ids: list
    codes: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str | None], rate: float) -> Probe:
        codes, _, bounds = normalised(texts)
        parts = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        used = [i for i, p in enumerate(parts) if len(p) >= Q]
        parts, ids = [parts[i] for i in used], [ids[i] for i in used]
        hashes = [qgram_hashes(p) for p in parts]
        every = np.concatenate([np.zeros(0, np.uint32), *hashes])
        item = np.repeat(np.arange(len(parts)), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in hashes]])
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        slots = np.zeros(1 << _SLOTS, bool)
        slots[_slot(grams)] = True
        n = np.array([len(p) for p in parts], np.int64)
        budget = np.array([edit_budget(int(k), rate) for k in n], np.int64)
        return cls(ids, parts, budget, n - Q + 1 - Q * budget, grams, np.append(first, len(every)), item[order], place[order], slots)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)


def _align(text: np.ndarray, item: np.ndarray, most: int) -> tuple[int, int] | None:
    """Fewest edits that turn ``item`` into a part of ``text``, and where that part ends; None beyond ``most``.

    Only diagonals that start inside the text are followed: a band as wide as
    the text has spare characters, and ``most`` more on its left.
    """
    width = max(1, len(text) - len(item) + 1 + 2 * most)
    lead = most
    padded = np.concatenate([np.full(lead, 0xFFFFFFFF, np.uint32), text, np.full(len(item) + width, 0xFFFFFFFF, np.uint32)])
    steps = np.arange(width)
    far = most + 1
    row = np.zeros(width, np.int64)
    for i, c in enumerate(item):
        moved = np.minimum(row + (padded[i:i + width] != c), np.append(row[1:], far) + 1)
        row = np.minimum.accumulate(moved - steps) + steps
        if row.min() > most:
            return None
    k = int(row.argmin())
    return int(row[k]), min(len(text), len(item) + k - lead)


def passages_in(probe: Probe, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) for the best region of each item in each text, in code points."""
    codes, origin, bounds = normalised(texts)
    h = qgram_hashes(codes)
    at = np.flatnonzero(probe.slots[_slot(h)]) if len(h) and len(probe.grams) else np.zeros(0, np.int64)
    gram = np.minimum(np.searchsorted(probe.grams, h[at]), max(0, len(probe.grams) - 1))
    text = np.searchsorted(bounds, at, side="right") - 1
    good = np.flatnonzero((probe.grams[gram] == h[at]) & (at + Q <= bounds[text + 1])) if len(at) else at
    if not len(good):
        return
    at, gram, text = at[good], gram[good], text[good]
    times = probe.first[gram + 1] - probe.first[gram]
    index = np.repeat(probe.first[gram] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    item = probe.item[index]
    step = probe.budget[item] + 1
    base = int(max(map(len, probe.codes)))  # keeps diagonals above zero
    diagonal = np.repeat(at, times) - probe.place[index] + base
    # Texts follow each other without gaps, so a band near a border can take hits of two texts; the text is part of the key.
    band = diagonal // step
    key = (np.repeat(text, times) * len(probe.codes) + item) * (len(codes) + 2 * base + 2) + band
    keys, counts = np.unique(key, return_counts=True)
    below = np.searchsorted(keys, keys - 1)
    below_ok = (below < len(keys)) & (keys[np.minimum(below, len(keys) - 1)] == keys - 1)
    total = counts + np.where(below_ok, counts[np.minimum(below, len(keys) - 1)], 0)
    # The pair (band - 1, band) is the wide band; a pair whose upper half is empty is part of another pair.
    unit = len(codes) + 2 * base + 2
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in keys[total >= probe.need[(keys // unit) % len(probe.codes)]].tolist():
        owner, b = divmod(k, unit)
        t, i = divmod(owner, len(probe.codes))
        e, n, w = int(probe.budget[i]), len(probe.codes[i]), int(probe.budget[i]) + 1
        a = max(int(bounds[t]), (b - 1) * w - base - e)
        z = min(int(bounds[t + 1]), (b + 1) * w - base + n + e)
        if z - a < n - e:
            continue
        got = _best_in(codes[a:z], probe.codes[i], e)
        if got and ((t, i) not in found or (got[2], a + got[0]) < (found[t, i][2], found[t, i][0])):
            found[t, i] = (a + got[0], a + got[1], got[2])
    for (t, i), (a, z, edits) in sorted(found.items()):
        yield t, i, int(origin[a]), int(origin[z - 1]) + 1, edits


def _best_in(region: np.ndarray, item: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the item in the region."""
    exact = region.tobytes().decode("utf-32-le", "surrogatepass").find(item.tobytes().decode("utf-32-le", "surrogatepass"))
    if exact >= 0:
        return exact, exact + len(item), 0
    got = _align(region, item, most)
    if got is None:
        return None
    edits, end = got
    back = _align(region[:end][::-1], item[::-1], most)
    start = max(0, end - back[1]) if back else max(0, end - len(item))
    return start, max(end, start + 1), edits


def probes(benchmark: DataFrame, rate: float, id_col: str, text_col: str, block_bytes: int) -> list[Probe]:
    """The benchmark in blocks: its bytes are summed first, and each block is bounded by about ``block_bytes``."""
    rows = narrow(benchmark, id=id_col, text=text_col).filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    out = []
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).orderBy("id", "text").collect()
        if part:
            out.append(Probe.of([r.id for r in part], [r.text for r in part], rate))
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Benchmark passages in texts: id, item, start, end, edits, similarity; a row for each text and item that meet.

    Case and everything but letters and digits don't count.  An item may have
    ``rate`` of its characters edited, less where it is so short that the
    lemma would see nothing; similarity is 1 - edits / length.  Items with
    fewer than eight characters identify nothing and are left out, as are
    null texts.  Of several places the one with the fewest edits, then the
    first, is given.  Every block of the benchmark is searched in all texts.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"id {kind}, item {item_kind}, start long, end long, edits long, similarity double"
    rows = narrow(docs, id=id_col, text=text_col)

    def search(probe):
        def work(texts, batch):
            hits = list(passages_in(probe, texts))
            ids = batch.column(0).to_pylist()
            return {"id": [ids[t] for t, *_ in hits], "item": [probe.ids[i] for _, i, *_ in hits], "start": [h[2] for h in hits],
                    "end": [h[3] for h in hits], "edits": [h[4] for h in hits],
                    "similarity": [1 - h[4] / len(probe.codes[h[1]]) for h in hits]}
        return map_texts(rows, "text", schema, work)

    found = docs.sparkSession.createDataFrame([], schema)
    for probe in probes(benchmark, rate, item_col, item_text_col, block_bytes):
        found = found.unionByName(search(probe))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Rows in whose text no passage is found; all columns stay, null texts too."""

    def clean(probe):
        def keep(texts):
            hit = {t for t, *_ in passages_in(probe, texts)}
            return [t not in hit for t in range(len(texts))]
        return keep

    for probe in probes(benchmark, rate, item_col, item_text_col, block_bytes):
        docs = filter_texts(docs, text_col, clean(probe))
    return docs
