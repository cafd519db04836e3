"""SentencePiece encoding and decoding; sampled segmentations without replacement.

A text's segmentations into pieces are the paths of a lattice.  A path's
probability is the product of its pieces' weights over the sum for all paths,
so suffix sums turn the lattice into choices between outgoing edges.  Gumbel
top-k: each path has a Gumbel-perturbed log probability, and the k greatest
are a sample of k different paths.  They are found by an A-star search from
the top: a set of paths that share a prefix has as its exact bound the
greatest perturbed value in it, which is drawn before the paths are, from a
Gumbel distribution cut off at its parent's bound.  The best set is split
along one sampled path; each branch not taken is a new set.

Weights follow Zipf's law on a piece's rank in the vocabulary, because the
model's merge ranks are no probabilities.  Pieces never reach over the start
of a run of blanks, so lattices are built once for each different word of a
run of texts, and numpy moves all words along together.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_texts, narrow

BLANK = "▁"
#: Bytes a model file may have at most; it travels with the tasks.
MODEL_BYTES = 16 << 20
_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_POINTS = 0x110000


def load_model(path: str) -> bytes:
    """The bytes of a model file on the driver, at most MODEL_BYTES."""
    with open(path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return model


class Vocabulary:
    """Pieces of a model as a trie over dense tables, with their log weights."""

    def __init__(self, model: bytes, temperature: float) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.processor
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        usual = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in usual):
            raise ValueError("a piece of the model reaches over the start of a blank")
        self.bytes = np.zeros(256, np.int32)
        for i in range(len(self.pieces)):
            if sp.is_byte(i):
                self.bytes[int(self.pieces[i][3:-1], 16)] = i
        self.has_bytes = any(sp.is_byte(i) for i in range(len(self.pieces)))
        #: What a piece stands for in UTF-8.
        self.raw = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.unknown = sp.unk_id()
        # Rank among usual pieces, best score first.
        scores = np.array([sp.get_score(i) for i in usual])
        rank = np.empty(len(usual))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(usual))
        self.weight = np.zeros(len(self.pieces))
        self.weight[usual] = -np.log(rank + 2) / temperature
        #: A character without a piece falls back to its bytes, each as unlikely as the last piece.
        self.fallback = -np.log(len(usual) + 2) / temperature
        single = {self.pieces[i]: i for i in usual if len(self.pieces[i]) == 1}
        longer = {self.pieces[i]: i for i in usual if len(self.pieces[i]) > 1}
        chars = sorted({c for p in longer for c in p})
        #: Class of a character in longer pieces (0: in none) and piece of a single one (-1: none), by code point.
        self.classes = np.zeros(_POINTS, np.int16)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = np.full(_POINTS, -1, np.int32)
        self.single[[ord(c) for c in single]] = list(single.values())
        number = {c: k + 1 for k, c in enumerate(chars)}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, i in longer.items():
            node = 0
            for c in piece:
                step = children[node].setdefault(number[c], len(children))
                if step == len(children):
                    children.append({})
                    ends.append(-1)
                node = step
            ends[node] = i
        self.width = len(chars) + 1
        # Leaves have no row: only inner nodes need one.
        inner = [n for n, c in enumerate(children) if c]
        row = np.zeros(len(children), np.int32)
        row[inner] = np.arange(len(inner))
        self.row = np.where([bool(c) for c in children], row, -1).astype(np.int32)
        self.moves = np.zeros((len(inner), self.width), np.int32)
        for n in inner:
            for c, to in children[n].items():
                self.moves[row[n], c] = to
        self.ends = np.array(ends, np.int32)


_VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary_of(model: bytes, temperature: float) -> Vocabulary:
    """The vocabulary of a model, built once in each worker."""
    key = hash((model, temperature))
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(model, temperature)
    return _VOCABULARIES[key]


@dataclass
class Lattice:
    """Edges of the lattices of different words, by the node they leave.

    Nodes are the characters of the words, one after the other; ``first`` is
    the first edge of a node, ``count`` how many it has.  ``step`` is an edge's
    length, ``piece`` its id (-1: the bytes of the character), ``log_p`` the log
    probability of taking it and ``cut`` the sum of probabilities up to it.
    """

    starts: np.ndarray
    sizes: np.ndarray
    points: np.ndarray
    first: np.ndarray
    count: np.ndarray
    step: np.ndarray
    piece: np.ndarray
    log_p: np.ndarray
    cut: np.ndarray


def build_lattice(words: list[str], vocabulary: Vocabulary) -> Lattice:
    """Edges by a walk of all nodes through the trie at once, choices by suffix sums."""
    v = vocabulary
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = len(points)
    ends = np.cumsum(sizes)
    left = (np.repeat(ends, sizes) - np.arange(total)).astype(np.int32)  # characters to the end of the word
    classes = v.classes[points]
    piece = v.single[points]
    bare = np.flatnonzero(piece < 0)
    single = v.weight[piece]
    single[bare] = v.fallback * _byte_counts(points[bare])
    # Nodes are ranked by what is left of their word, so that suffix sums go through slices.
    # Small integers sort by radix.
    by_left = np.argsort(left.astype(np.uint16) if total and left.max() < 1 << 16 else left, kind="stable")
    rank = np.empty(total + 1, np.int32)
    rank[by_left] = np.arange(total, dtype=np.int32)
    nodes, pieces = [np.arange(total, dtype=np.int32)], [piece]
    at, state = nodes[0], v.moves[0, classes]
    at, state = at[state > 0], state[state > 0]
    depth = 1
    while len(at):
        go = (left[at] > depth) & (v.row[state] >= 0)
        at, state = at[go], state[go]
        state = v.moves[v.row[state], classes[at + depth]]
        go = state > 0
        at, state = at[go], state[go]
        depth += 1
        done = v.ends[state]
        hit = done >= 0
        nodes.append(at[hit])
        pieces.append(done[hit])
    # A node has at most one edge of each length, so its edges find their places by length without a sort.
    filled = np.zeros(total, np.int64)
    for at in nodes:
        filled[at] += 1
    count = filled[by_left]
    first = np.cumsum(count) - count
    edges = int(count.sum())
    node, step, piece, weight = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
    place = first[rank[:total]]
    for k, (at, ids) in enumerate(zip(nodes, pieces), 1):
        to = place[at]
        node[to], step[to], piece[to] = at, k, ids
        weight[to] = single if k == 1 else v.weight[ids]
        place[at] += 1
    rank[total] = total
    target = np.where(step == left[node], total, rank[np.minimum(node + step, total)])
    # A node's suffix sum is taken relative to its one-character edge, which is always its first.
    suffix, log_p = np.zeros(total + 1), np.empty(len(node))
    borders = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=1)[1:])])
    for p, q in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if p == q:
            continue
        a, z = int(first[p]), int(first[q - 1] + count[q - 1])
        value = weight[a:z] + suffix[target[a:z]]
        begin = first[p:q] - a
        base = value[begin]
        suffix[p:q] = base + np.log(np.add.reduceat(np.exp(value - np.repeat(base, count[p:q])), begin))
        log_p[a:z] = value - np.repeat(suffix[p:q], count[p:q])
    log_p = np.minimum(0.0, log_p)
    cut = np.exp(log_p)
    more, k = np.flatnonzero(count > 1), 1
    while len(more):
        e = first[more] + k
        cut[e] += cut[e - 1]
        k += 1
        more = more[count[more] > k]
    cut[first + count - 1] = np.inf
    place = rank[:total]
    return Lattice(ends - sizes, sizes, points, first[place], count[place], step, piece, log_p, cut)


def _byte_counts(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def _uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) by key: the same wherever and however often they are drawn."""
    x = key + np.uint64((stream * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def _gumbel(key: np.ndarray, stream: int, at: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Gumbel values around ``at``, cut off at ``below``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = at - np.log(-np.log(_uniform(key, stream)))
        return np.where(np.isneginf(at), -np.inf, -np.logaddexp(-below, -g))


@dataclass
class Sample:
    """Paths of all texts of a run: the edge that leaves each character of the joined texts, -1 inside a piece.

    ``before`` is the log probability of a path up to each character.
    """

    edge: np.ndarray
    before: np.ndarray
    log_p: np.ndarray
    value: np.ndarray
    made: np.ndarray


class Search:
    """The A-star search over a run of texts, all texts in step.

    Open sets are kept by path and character: ``bound[j][c]`` is the bound of
    the paths that follow path j up to c and leave it there.
    """

    def __init__(self, texts: list[str], keys: np.ndarray, vocabulary: Vocabulary) -> None:
        joined = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        words = [_WORDS.findall(t) for t in joined]
        index: defaultdict[str, int] = defaultdict(count().__next__)
        kinds = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        self.v, self.lattice = vocabulary, build_lattice(list(index), vocabulary)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
        sizes = self.lattice.sizes[kinds]
        self.word_at = np.cumsum(sizes) - sizes  # first character of each word
        self.word_end = self.word_at + sizes
        total = int(self.bounds[-1])
        self.node = np.repeat(self.lattice.starts[kinds] - self.word_at, sizes) + np.arange(total)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        local = np.arange(total) - self.bounds[self.text_of]
        # A key for each character: the row's key and the place in its text.
        self.key = keys[self.text_of] + local.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        self.keys, self.total, self.n = keys, total, len(texts)

    def _walk(self, stream: int, at: np.ndarray, ends: np.ndarray, edge: np.ndarray) -> None:
        """Sample edges from characters ``at`` to the ends of their words, into ``edge``."""
        lattice = self.lattice
        while len(at):
            u = _uniform(self.key[at], stream)
            e = lattice.first[self.node[at]]
            more = np.flatnonzero(u > lattice.cut[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > lattice.cut[e[more]]]
            edge[at] = e
            at = at + lattice.step[e]
            go = at < ends
            at, ends = at[go], ends[go]

    def _before(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of a path up to each character, and of all of it by text; text by text, so that a sum doesn't depend on other texts."""
        log_p = np.where(edge >= 0, self.lattice.log_p[edge], 0.0)
        out, sums = np.zeros(self.total), np.zeros(self.n)
        for t, (a, z) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())):
            if z > a:
                np.cumsum(log_p[a:z - 1], out=out[a + 1:z])
                sums[t] = out[z - 1] + log_p[z - 1]
        return out, sums

    def _open(self, edge: np.ndarray, before: np.ndarray, stream: int, since: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Bounds of the sets that leave a path at its pieces from character ``since`` of each text on."""
        at = np.flatnonzero((edge >= 0) & (np.arange(self.total) >= since[self.text_of]))
        text = self.text_of[at]
        prefix = before[at]
        with np.errstate(divide="ignore"):
            rest = np.log(-np.expm1(self.lattice.log_p[edge[at]]))
        rest[self.lattice.count[self.node[at]] == 1] = -np.inf
        out = np.full(self.total, -np.inf)
        out[at] = _gumbel(self.key[at], stream, prefix + rest, value[text])
        return out

    def run(self, k: int) -> tuple[list[Sample], np.ndarray]:
        """Up to k different paths for each text, best first, and the value of the next one (-inf: there is none)."""
        edge = np.full(self.total, -1, np.int64)
        self._walk(0, self.word_at, self.word_end, edge)
        root = -np.log(-np.log(_uniform(self.keys, 1)))
        before, log_p = self._before(edge)
        samples = [Sample(edge, before, log_p, root, np.ones(self.n, bool))]
        bound = [self._open(edge, before, 2, self.bounds[:-1], root)]
        taken: dict[tuple[int, int], list[int]] = {}  # edges tried at a split (path, character), the path's own included
        filled = np.flatnonzero(np.diff(self.bounds) > 0)
        for s in range(1, k + 1):
            tops = np.full((len(bound), self.n), -np.inf)
            if len(filled):
                for j, b in enumerate(bound):
                    tops[j, filled] = np.maximum.reduceat(b, self.bounds[:-1][filled])
            path, value = tops.argmax(axis=0), tops.max(axis=0)
            if s == k:
                return samples, value
            self._split(s, path, value, samples, bound, taken)
        return samples, np.full(self.n, -np.inf)

    def _split(self, s: int, path: np.ndarray, value: np.ndarray, samples: list[Sample], bound: list[np.ndarray], taken: dict) -> None:
        """Take the best open set of each text apart: sample s is its best path, the rest stays open."""
        lattice, made = self.lattice, np.flatnonzero(value > -np.inf)
        edge = np.full(self.total, -1, np.int64)
        since = self.bounds[1:].copy()  # where the path is its own: after the split
        at = np.zeros(len(made), np.int64)
        for i, t in enumerate(made.tolist()):
            a, z, j = int(self.bounds[t]), int(self.bounds[t + 1]), int(path[t])
            at[i] = a + int(np.argmax(bound[j][a:z] == value[t]))
            edge[a:at[i]] = samples[j].edge[a:at[i]]
        draws = _uniform(self.key[at], 3 * s + 5)
        rest = np.full(len(made), -np.inf)  # log probability of what is left of the set: the other edges
        for i, t in enumerate(made.tolist()):
            c, j = int(at[i]), int(path[t])
            tried = taken.setdefault((j, c), [int(samples[j].edge[c])])
            first = int(lattice.first[self.node[c]])
            others = [e for e in range(first, first + int(lattice.count[self.node[c]])) if e not in tried]
            p = np.exp(lattice.log_p[others])
            sums = np.cumsum(p)
            k = min(int(np.searchsorted(sums, draws[i] * sums[-1])), len(others) - 1)
            edge[c] = others[k]
            tried.append(others[k])
            if len(others) > 1:
                rest[i] = samples[j].before[c] + np.log(np.delete(p, k).sum())
            since[t] = c + int(lattice.step[others[k]])
        left = _gumbel(self.key[at], 3 * s + 6, rest, value[made])
        for i, t in enumerate(made.tolist()):
            bound[int(path[t])][at[i]] = left[i]
        after = since[made]
        end = self.word_end[np.searchsorted(self.word_at, at, side="right") - 1]
        open_word = after < end
        later = self.word_at >= since[self.text_of[self.word_at]]
        self._walk(3 * s + 4, np.concatenate([after[open_word], self.word_at[later]]),
                   np.concatenate([end[open_word], self.word_end[later]]), edge)
        before, log_p = self._before(edge)
        samples.append(Sample(edge, before, log_p, value, value > -np.inf))
        bound.append(self._open(edge, before, 3 * s + 7, since, value))

    def ids(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids along the paths, and bounds by text; a character without a piece gives its bytes."""
        at = np.flatnonzero(edge >= 0)
        ids = self.lattice.piece[edge[at]]
        times = np.ones(len(at), np.int64)
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            points = self.lattice.points[self.node[at[bare]]]
            raw = [chr(p).encode("utf-8", "surrogatepass") if self.v.has_bytes else b"\0" for p in points.tolist()]
            times[bare] = [len(r) for r in raw]
            out = np.repeat(ids, times)
            out[out < 0] = self.v.bytes[np.frombuffer(b"".join(raw), np.uint8)] if self.v.has_bytes else self.v.unknown
            ids = out
        counts = np.concatenate([[0], np.cumsum(times)])
        return ids.astype(np.int32), counts[np.searchsorted(at, self.bounds)]


def row_keys(ids: list, seed: int) -> np.ndarray:
    """A number for each row from its key's text, and the seed."""
    import xxhash
    return np.array([xxhash.xxh64_intdigest(repr(i), seed) for i in ids], np.uint64)


def decoded(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """Texts of runs of ids: pieces joined, bytes as UTF-8, blanks as spaces, without the first."""
    raw, flat = vocabulary.raw, ids.tolist()
    texts = [b"".join([raw[i] for i in flat[a:z]]).decode("utf-8", "replace") for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return [t[1:] if t.startswith(" ") else t for t in texts]


def sample_segmentations(docs: DataFrame, model: bytes, k: int = 2, temperature: float = 1.0, seed: int = 0,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k different segmentations of each text: id, sample, ids, n_pieces, log_prob, value, inclusion, round_trip.

    ``log_prob`` is the path's log probability, ``value`` its perturbed one;
    ``inclusion`` the probability that a path so likely is above the value of
    the first path left out (1 where none is).  ``round_trip`` says that the
    ids decode to the text.  Draws depend on the row's key and the seed alone,
    so repeated rows have the same samples.  A text with fewer segmentations
    than k gives all it has; an empty one gives its empty segmentation, a null
    text counts as empty.  A U+2581 in a text reads as a space.  Whole texts
    are segmented, other columns left out.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    kind = dict(docs.dtypes)[id_col]

    def work(texts, batch):
        v = vocabulary_of(model, temperature)
        texts = [t or "" for t in texts]
        ids = batch.column(0).to_pylist()
        search = Search(texts, row_keys(ids, seed), v)
        samples, rest = search.run(k)
        parts = {name: [] for name in ("row", "sample", "n_pieces", "log_prob", "value", "inclusion", "round_trip")}
        flat, lengths = [], []
        for s, sample in enumerate(samples):
            made = np.flatnonzero(sample.made)
            own, bounds = search.ids(sample.edge)
            # Texts without this sample have no pieces in it.
            back = decoded(own, bounds, v)
            parts["row"].append(made)
            parts["sample"].append(np.full(len(made), s))
            parts["n_pieces"].append(np.diff(bounds)[made])
            parts["log_prob"].append(sample.log_p[made])
            parts["value"].append(sample.value[made])
            with np.errstate(over="ignore"):
                parts["inclusion"].append(-np.expm1(-np.exp(sample.log_p[made] - rest[made])))
            parts["round_trip"].append(np.array([back[i] == texts[i].replace(BLANK, " ") for i in made.tolist()], bool))
            flat.append(own)
            lengths.append(np.diff(bounds)[made])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        joined = {name: np.concatenate(x) for name, x in parts.items()}
        return {"id": batch.column(0).take(pa.array(joined.pop("row"))), **joined,
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat), pa.int32()))}

    out = map_texts(narrow(docs, id=id_col, text=text_col), "text",
                    f"id {kind}, sample int, ids array<int>, n_pieces long, log_prob double, value double, inclusion double, round_trip boolean", work)
    return out.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids: the model's own (best) encoding of each text; null counts as empty."""
    kind = dict(docs.dtypes)[id_col]

    def work(texts, batch):
        sp = vocabulary_of(model, 1.0).processor
        return {"id": batch.column(0), "ids": sp.encode([t or "" for t in texts], num_threads=1)}

    return map_texts(narrow(docs, id=id_col, text=text_col), "text", f"id {kind}, ids array<int>", work).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of arrays of piece ids; null counts as empty."""
    kind = dict(coded.dtypes)[id_col]

    def run(batches):
        v = vocabulary_of(model, 1.0)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.array([i for x in lists for i in x], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded(flat, bounds, v), pa.string())], names=["id", "text"])

    return narrow(coded, id=id_col, ids=ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
