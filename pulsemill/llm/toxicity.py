"""Toxicity as a weighted finite-state grammar over clauses.

Transducers for insults, threats, targets, negation and reported speech read
the same clause and are composed into one machine; what it emits are matched
clauses (an insult, aimed at someone, denied, quoted), not isolated words.
Insult stems are learned from labelled text: words and word beginnings that
stand almost only in toxic texts, in many different places.  A logistic
weight for each kind of match is learned too, from a prior that says what the
grammar means where labels say nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, filter_texts, map_texts, narrow, stored

#: The closed classes of the grammar in English, German, French and Spanish.
THREATS = ("kill you", "hurt you", "destroy you", "beat you", "find you", "bring dich um", "mach dich fertig", "schlag dich",
           "vais te tuer", "te frapper", "te detruire", "voy a matarte", "te voy a matar", "te voy a pegar")
TARGETS = ("you", "your", "they", "them", "he", "she", "du", "dich", "dein", "ihr", "euch", "sie", "tu", "toi", "vous", "ton",
           "tes", "ils", "usted", "ustedes", "ti", "tus", "ellos")
NEGATIONS = ("not", "no", "never", "nobody", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca",
             "ni", "tampoco")
REPORTS = ("said", "says", "called", "calls", "quoted", "wrote", "told", "sagte", "nannte", "schrieb", "dit", "traita", "dijo", "llamó",
           "escribió")

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:,\n]")
PREFIXES = (4, 5, 6)
CONTEXTS = 64
#: Counts that a task holds before it passes them on.
MOST_COUNTS = 150_000

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Matches by kind; each is a feature of a text, and so is the greatest weight of a stem.
FEATURES = ("insult", "insult at target", "insult denied", "insult quoted", "threat", "threat denied or quoted", "stem weight")
#: What the weights are before any label is seen, and how many labels that is worth.
PRIOR = np.array([3.0, 1.0, 1.0, 1.0, 3.0, 0.5, 0.5, -3.0])
PRIOR_STRENGTH = 1.0


class Transducer:
    """States and outputs by (state, symbol); unlisted symbols take ``otherwise``."""

    def __init__(self, moves: dict[tuple[int, int], int], otherwise: dict[int, int]):
        self.moves, self.otherwise = moves, otherwise

    def step(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), self.otherwise[state])


def window(symbol: int, width: int) -> Transducer:
    """In a state above zero for ``width`` words after a symbol."""
    return Transducer({(s, symbol): width for s in range(width + 1)}, {s: max(0, s - 1) for s in range(width + 1)})


def latch(symbol: int) -> Transducer:
    """In state 1 from a symbol to the end of the clause."""
    return Transducer({(0, symbol): 1}, {0: 0, 1: 1})


#: The composed parts: denial reaches three words, a target five, a quotation the rest of the clause.
PARTS = (window(NEGATION, 3), latch(REPORT), window(TARGET, 5))


@lru_cache(maxsize=None)
def composed(state: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The product machine, built as its states are met."""
    return tuple(p.step(s, symbol) for p, s in zip(PARTS, state))


def read_clause(symbols: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """Matches (feature, weight) in one clause of (symbol, weight).

    A match takes the kind that the state before it says; a target up to
    three words after an insult counts like one before it.
    """
    state, out, pending = (0,) * len(PARTS), [], None
    for symbol, weight in symbols:
        denied, quoted, aimed = (s > 0 for s in state)
        if symbol == INSULT:
            kind = 2 if denied else 3 if quoted else 1 if aimed else 0
            out.append((kind, weight))
            pending = (len(out) - 1, 3) if kind == 0 else None
        elif symbol == THREAT:
            out.append((5 if denied or quoted else 4, weight))
        elif pending:
            at, left = pending
            if symbol == TARGET:
                out[at], pending = (1, out[at][1]), None
            else:
                pending = (at, left - 1) if left > 1 else None
        state = composed(state, symbol)
    return out


@dataclass
class Grammar:
    """Stems with weights, and the weight of each feature and of the constant."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def weight_of(self, word: str) -> float | None:
        found = self.words.get(word)
        for n in PREFIXES:
            if (w := self.prefixes.get(word[:n])) is not None and (found is None or w > found):
                found = w
        return found

    def finder(self) -> ahocorasick.Automaton:
        finder = ahocorasick.Automaton()
        for stem in {*self.words, *self.prefixes, *THREATS}:
            finder.add_word(stem, len(stem))
        finder.make_automaton()
        return finder

    def features(self, texts: list[str | None], finder: ahocorasick.Automaton) -> np.ndarray:
        """Feature vectors: the logarithm of 1 + the matches of each kind, and the greatest stem weight."""
        out = np.zeros((len(texts), len(FEATURES)))
        for i, text in enumerate(texts):
            lowered = text.lower() if text else ""
            done = 0  # the end of the clause read last
            for end, size in finder.iter(lowered) if lowered else ():
                start = end + 1 - size
                if start < done or start and lowered[start - 1].isalpha():
                    continue
                a = _clause_start(lowered, start, done)
                m = CLAUSE_END.search(lowered, end + 1)
                done = m.start() if m else len(lowered)
                for kind, weight in read_clause(self.symbols(lowered[a:done])):
                    out[i, kind] += 1
                    out[i, -1] = max(out[i, -1], weight)
        out[:, :-1] = np.log1p(out[:, :-1])
        return out

    def symbols(self, clause: str) -> list[tuple[int, float]]:
        found = []
        threats = {clause.count(" ", 0, m.start()) for t in THREATS for m in re.finditer(rf"\b{t}\b", clause)} if any(t in clause for t in THREATS) else ()
        for k, m in enumerate(WORD.finditer(clause)):
            word = m.group()
            if (w := self.weight_of(word)) is not None:
                found.append((INSULT, w))
            elif threats and clause.count(" ", 0, m.start()) in threats:
                found.append((THREAT, 1.0))
            else:
                found.append((_CLASSES.get(word, OTHER), 0.0))
        return found

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_CLASSES = {**dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT)}


def _clause_start(text: str, at: int, least: int) -> int:
    """Where the clause around ``at`` starts, not before ``least``."""
    return max(least, *(text.rfind(c, least, at) + 1 for c in ".!?;:,\n"))


_FINDERS: dict[tuple, ahocorasick.Automaton] = {}


def finder_for(grammar: Grammar) -> ahocorasick.Automaton:
    """The grammar's stem finder, built once in each worker."""
    key = (*sorted(grammar.words), None, *sorted(grammar.prefixes))
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = grammar.finder()
    return _FINDERS[key]


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stem, kind (0 word, else prefix length), toxic texts, clean texts, contexts in toxic texts as a bit mask."""
    counts: dict[tuple[str, int], list[int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        counts.clear()
        for a in range(0, len(items), 50_000):
            part = items[a:a + 50_000]
            masks = np.array([c[2] for _, c in part], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.int32()),
                 *(pa.array([c[j] for _, c in part], pa.int64()) for j in (0, 1)), pa.array(masks, pa.int64())],
                names=["stem", "kind", "toxic", "clean", "contexts"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            before, seen = "", {}
            for word in WORD.findall(text.lower() if text else ""):
                bit = 1 << (xxhash.xxh32_intdigest(before) % CONTEXTS) if toxic else 0
                seen[word, 0] = seen.get((word, 0), 0) | bit
                for n in PREFIXES:
                    if len(word) > n:
                        seen[word[:n], n] = seen.get((word[:n], n), 0) | bit
                before = word
            for key, mask in seen.items():
                c = counts.setdefault(key, [0, 0, 0])
                c[0 if toxic else 1] += 1
                c[2] |= mask
            if len(counts) > MOST_COUNTS:
                yield from flush()
    yield from flush()


def learn_stems(labelled: DataFrame, least: int = 8, purity: float = 0.75, most: int = 4096) -> list:
    """Rows (stem, kind, toxic, clean): seen in ``least`` contexts of toxic texts, and ``purity`` of its texts are toxic.

    Contexts are preceding words, so that copies of one text count once.  The
    ``most`` frequent are taken: the bound of the grammar.
    """
    return (labelled.select("text", "toxic").mapInArrow(_count_stems, "stem string, kind int, toxic long, clean long, contexts long")
            .groupBy("stem", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                                         F.bit_count(F.bit_or("contexts")).alias("n"))
            .filter((F.col("n") >= least) & (F.col("toxic") >= purity * (F.col("toxic") + F.col("clean"))))
            .orderBy(F.desc("toxic"), "stem", "kind").limit(most).collect())


def grammar_of(stems: list, toxic: int, clean: int) -> Grammar:
    """A grammar with the stems; of a word beginning and a longer stem that explains nine tenths of it, the longer stays."""
    grammar = Grammar()
    for s in stems:
        if s.kind and any(o.stem != s.stem and o.stem.startswith(s.stem) and o.toxic >= 0.9 * s.toxic for o in stems):
            continue
        odds = np.log((s.toxic + 0.5) / (toxic + 1)) - np.log((s.clean + 0.5) / (clean + 1))
        (grammar.prefixes if s.kind else grammar.words)[s.stem] = float(min(6.0, odds)) / 3
    return grammar


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic weights around the prior, by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + PRIOR_STRENGTH * (w - PRIOR)
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_grammar(docs: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = 20_000, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic", seed: int = 11) -> Grammar:
    """Learn from at most ``rows`` labelled texts, those with the smallest hashes of their ids.

    ``train`` restricts the labels.  Labels that are null, or whose text is
    not there, are left out; of several labels of an id the largest counts.
    Without labels the grammar has its prior weights and no stems.
    """
    chosen = labels.filter(train) if train is not None else labels
    chosen = (chosen.filter(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id"))
              .agg(F.max(col(label_col)).cast("int").alias("toxic")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows))
    sample = stored(narrow(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("text", "toxic"), "labelled")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    grammar = grammar_of(learn_stems(sample), n.get(1, 0), n.get(0, 0))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def work(texts, batch):
        x = grammar.features(texts, finder_for(grammar))
        return {"y": batch.column(1), **{f: x[:, i] for i, f in enumerate(names)}}

    seen = map_texts(sample, "text", "y int, " + ", ".join(f"{f} double" for f in names), work)
    # Equal vectors are counted together before anything is collected.
    table = seen.groupBy("y", *names).agg(F.count(F.lit(1)).alias("n")).collect()
    if table:
        times = np.array([r.n for r in table])
        x = np.repeat(np.array([[r[f] for f in names] for r in table]), times, axis=0)
        grammar.weights = fit_weights(x, np.repeat(np.array([float(r.y) for r in table]), times))
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 if score >= 0.5), clauses (matched in all) of each row.

    Null and empty texts have the score of a text without matches.  Whole
    texts are read; other columns are left out.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(texts, batch):
        x = grammar.features(texts, finder_for(grammar))
        score = grammar.scores(x)
        return {"id": batch.column(0), "score": score, "predicted": (score >= 0.5).astype(np.int32),
                "clauses": np.rint(np.expm1(x[:, :-1]).sum(axis=1)).astype(np.int64)}

    out = map_texts(narrow(docs, id=id_col, text=text_col), "text", f"id {kind}, score double, predicted int, clauses long", work)
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """Rows with a score below ``at``; all columns stay."""
    return filter_texts(docs, text_col, lambda texts: grammar.scores(grammar.features(texts, finder_for(grammar))) < at)
