"""Language identification by cross-parsing entropy.

For each language, a suffix automaton holds labelled text.  A text is parsed
greedily into the longest phrases that occur in it, and the language that
needs the fewest phrases, weighted by the bits that name a phrase, wins.  The
automata are dense tables; numpy moves all texts of a batch through all of
them in step.  A phrase also ends every ``SEGMENT`` letters, for every
language alike: so a long text is many lanes and not one that all wait for.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, map_texts, narrow

SPACE = 0
SEGMENT = 1024
_POINTS = 0x110000


class SuffixAutomaton:
    """Suffix automaton of a sequence of small integers."""

    def __init__(self, symbols) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0
        for s in symbols:
            self._extend(s)

    def _extend(self, s: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        self.last = cur

    def table(self, symbols: int) -> np.ndarray:
        """Dense moves: next state * 4, plus the phrases that end there.

        Where a phrase can't go on, it ends and the symbol starts the next; a
        symbol that never occurs is a phrase of its own and leads to the root.
        """
        root = np.zeros(symbols, np.int32)
        for s, t in self.next[0].items():
            root[s] = t
        unseen = root == 0
        out = np.broadcast_to(root * 4 + np.where(unseen, 2, 1), (len(self.next), symbols)).astype(np.int32)
        out[0] = np.where(unseen, 1, root * 4)  # at the root no phrase is under way
        for state, moves in enumerate(self.next):
            for s, t in moves.items():
                out[state, s] = t * 4
        return out


class CrossParser:
    """The automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        letters = sorted({c for t in samples.values() for c in t.lower() if c.isalpha() and len(c) == 1})
        known = {c: i + 1 for i, c in enumerate(letters)}
        self.symbols = len(known) + 2
        self.codes = np.zeros(_POINTS, np.uint8 if self.symbols < 256 else np.uint16)
        for i in range(_POINTS):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                self.codes[i] = known.get(c.lower(), self.symbols - 1)
        self.bits, tables, roots, at = [], [], [], 0
        for lang in self.langs:
            seq = self.encode([samples[lang]])[0].tolist()
            own = SuffixAutomaton(seq).table(self.symbols)
            tables.append(own + np.int32(4 * at))  # states are numbered through all languages
            roots.append(at)
            at += len(own)
            self.bits.append(np.log2(max(2, len(seq))))
        self.table = np.concatenate(tables).ravel()
        self.roots = np.array(roots, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, runs of other characters as one SPACE, and where each text starts (and the end)."""
        raw = self.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) for t in texts])
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != SPACE) | (raw[:-1] != SPACE)
        keep[ends[:-1][ends[:-1] < len(raw)]] = True  # a text doesn't depend on the one before it
        kept = np.concatenate([[0], np.cumsum(keep)])
        return raw[keep], np.concatenate([[0], kept[ends]])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases each text needs in each language (text, language), and the letters in each text."""
        codes, bounds = self.encode(texts)
        sizes = np.diff(bounds)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = bounds[:-1][owner] + number * SEGMENT
        lengths = np.minimum(SEGMENT, bounds[1:][owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        starts, lens, owner = starts[order], lengths[order], owner[order]
        counts = np.zeros((len(self.langs), len(owner)), np.int32)
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        # active[t]: how many segments are longer than t, so each step works on a slice
        active = len(owner) - np.searchsorted(lens[::-1], np.arange(int(lens.max(initial=0))), side="right")
        for t, n in enumerate(active.tolist()):
            move = self.table[state[:, :n] * np.int32(self.symbols) + codes[starts[:n] + t]]
            counts[:, :n] += move & 3
            state[:, :n] = move >> 2
        counts += state != self.roots[:, None]  # the phrase that the end cuts off
        out = np.stack([np.bincount(owner, c, len(texts)) for c in counts], axis=1).astype(np.int64)
        letters = np.concatenate([[0], np.cumsum(codes != SPACE)])
        return out, letters[bounds[1:]] - letters[bounds[:-1]]

    def classify(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text.  Ties go to the first language by name."""
        counts, letters = self.phrases(texts)
        cost = counts * np.array(self.bits)
        best = cost.argmin(axis=1)
        if len(self.langs) > 1:
            two = np.sort(cost, axis=1)[:, :2]
            score = two[:, 1] / (two[:, 0] + two[:, 1])
        else:
            score = np.ones(len(texts))
        lang = [self.langs[k] if n else "und" for k, n in zip(best, letters)]
        return lang, np.where(letters > 0, score, 0.0).tolist()


def sample_texts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
                 chars: int = 40_000, texts: int = 64, seed: int = 7) -> dict[str, str]:
    """Labelled text by language: whole texts of at most ``texts`` rows, cut off at ``chars`` characters in all.

    The rows are those with the smallest hashes.  This is the bound on what is
    learned from, whatever the size of ``docs``; null labels and texts are left out.
    """
    rows = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"),
                       F.xxhash64(col(id_col), F.lit(seed)).alias("place")).filter("lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy("place", "text")
    part = rows.select("lang", "place", F.substring("text", 1, chars).alias("text")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= texts)
    joined: dict[str, str] = {}
    for row in part.orderBy("lang", "n").toLocalIterator():
        if len(joined.get(row.lang, "")) < chars:
            joined[row.lang] = (joined.get(row.lang, "") + " " + row.text)[:chars]
    return joined


def identify_language(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each text: id, lang_pred, score (0.5 to 1 between the two best; 1 with one language).

    A text that is null or has no letter is ``und`` with score 0; so is every
    text where nothing was learned.  Whole texts are parsed.  There is a row
    for each input row; its other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(texts, batch):
        if not samples:
            return {"id": batch.column(0), "lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        lang, score = parser_for(samples).classify([t or "" for t in texts])
        return {"id": batch.column(0), "lang_pred": lang, "score": score}

    out = map_texts(narrow(docs, id=id_col, text=text_col), "text", f"id {kind}, lang_pred string, score double", work, chars=8 << 20)
    return out.withColumnRenamed("id", id_col)


#: The parser a Python worker has built; workers live on between tasks.
_BUILT: dict[int, CrossParser] = {}


def parser_for(samples: dict[str, str]) -> CrossParser:
    """The parser of these samples, built once in each worker."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = CrossParser(samples)
    return _BUILT[key]


def crc_part(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold a row is in."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts
