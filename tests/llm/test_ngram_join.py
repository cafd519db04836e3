"""The token-group join against all pairs."""

import random

import numpy as np
import pytest

from pulsemill.llm import ngram_join as nj
from test_dedup import joined


def sets_of(text, words=5):
    parts = (text or "").encode().lower().split()
    if not parts:
        return frozenset()
    width = min(words, len(parts))
    return frozenset(tuple(parts[i:i + width]) for i in range(len(parts) - width + 1))


def brute(pairs, percent=80):
    sets = [sets_of(t) for _, t in pairs]
    holders = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    links = set()
    for i, s in enumerate(sets):
        near = {}
        for t in s:
            for j in holders[t]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        links |= {(i, j) for j, both in near.items() if 100 * both >= percent * (len(s) + len(sets[j]) - both)}
    root = joined(range(len(pairs)), links)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted(((d, len(sets[i]), least.get(root[i])) for i, (d, _) in enumerate(pairs)), key=str), links


def near_copies(rng, vocab, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = words(60)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "a b c d e", "A b C d e f", "a b c d e f g"]
    for _ in range(30):
        texts += near_copies(rng, vocab, words(rng.randrange(8, 160)), rng.randrange(1, 6), 4)
    texts += near_copies(rng, vocab, words(150), 130, 6)  # a family that links in chains
    texts += [" ".join(passage + words(rng.randrange(5, 25))) for _ in range(90)]  # share a passage, few link
    texts += [" ".join(words(20) + passage + words(200)) for _ in range(20)]
    texts += [texts[40]] * 60 + ["one two"] * 5
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    return pairs + [(None, texts[45]), (None, "no id at all here but words"), (3, None), pairs[0]]


@pytest.mark.parametrize("seed, cap, group", [(1, 64, 64), (2, 4, 8), (3, 2, 3), (4, 8, 1)])
def test_like_all_pairs(docs_of, monkeypatch, seed, cap, group):
    monkeypatch.setattr(nj, "CAP", cap)
    monkeypatch.setattr(nj, "GROUP", group)
    monkeypatch.setattr(nj, "QUERIES", 7)
    pairs = corpus(seed)
    want, links = brute(pairs)
    assert len(links) > 100
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.near_documents(docs_of(pairs)).collect()]
    assert sorted(got, key=str) == want


def test_other_thresholds(docs_of):
    pairs = corpus(5)
    want, _ = brute(pairs, 60)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.near_documents(docs_of(pairs), percent=60).collect()]
    assert sorted(got, key=str) == want


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want, links = brute(pairs)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.near_documents(docs).collect()]
    assert links and sorted(got, key=str) == want


def test_nothing_and_a_very_long_text(docs_of):
    assert nj.near_documents(docs_of([])).count() == 0
    rng = random.Random(7)
    long = " ".join(str(rng.randrange(10 ** 6)) for _ in range(400_000))
    got = nj.near_documents(docs_of([(5, long), (4, long + " tail"), (9, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (5, 4), (9, 9)]


def test_bounds_are_those_of_the_definition():
    for percent in (60, 80, 93):
        for n in range(1, 60):
            for m in range(1, 60):
                least = nj.least_overlap(n, m, percent)
                fits = [b for b in range(min(n, m) + 1) if 100 * b >= percent * (n + m - b)]
                assert (min(fits) if fits else least > min(n, m)) in (least, True)
            assert nj.prefix_size(n, percent) == n - min(b for b in range(n + 1) if 100 * b >= percent * n) + 1


def test_counts_over_batches():
    import pyarrow as pa
    rng = np.random.default_rng(8)
    rows = sorted((int(t), int(h), 0) for t, h in zip(rng.integers(0, 40, 3000), rng.integers(0, 300, 3000)))
    rows += sorted((50, int(h), 0) for h in rng.integers(0, 90, 700))
    want = {}
    for t, h, _ in set(rows):
        want.setdefault(t, set()).add(h)
    for step in (1, 7, 100, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i:i + step])], names=["token", "h1", "h2"]) for i in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in nj._shared(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted((h, 0, t, min(len(s), nj.CAP + 1)) for t, s in want.items() if len(s) > 1 for h in s)
