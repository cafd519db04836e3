"""Quotient filters round trip; phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pulsemill.llm import collocations as co
from pulsemill.llm import quotient as qf


@pytest.mark.parametrize("m, width", [(1, 1), (2, 3), (2, 17), (3, 20), (4, 16), (4, 17), (5, 25), (5, 26), (5, 33), (2, 64)])
def test_filters_lose_nothing(m, width):
    rng = np.random.default_rng(m * 100 + width)
    ids = [rng.integers(0, min(1 << width, 1 << 63), 3000).astype(np.uint64) for _ in range(m)]
    ids = [np.concatenate([x, x[:500]]) for x in ids]
    bits = qf.limb_bits(m * width)
    limbs = qf.packed(ids, width)
    assert all((a == b).all() for a, b in zip(ids, qf.unpacked(limbs, m, width)))
    mixed = qf.permuted(limbs, bits)
    assert all((a == b).all() for a, b in zip(limbs, qf.restored(mixed, bits)))
    keys, counts = qf.summed(mixed, rng.integers(1, 400, len(ids[0])) ** 3)
    for skip in {0, min(3, bits[0])}:
        heads = (keys[0] >> np.uint64(bits[0] - skip)).astype(int) if skip else np.zeros(len(counts), int)
        for head in np.unique(heads):
            use = heads == head
            back, n = qf.decoded(qf.encoded([x[use] for x in keys], counts[use], bits, skip), bits, skip, int(head))
            assert (n == counts[use]).all() and all((a == b[use]).all() for a, b in zip(back, keys))
    want = Counter()
    for key, n in zip(zip(*[x.tolist() for x in mixed]), [1] * len(ids[0])):
        want[key] += n
    keys, counts = qf.summed(mixed, np.ones(len(ids[0]), np.int64))
    assert dict(zip(zip(*[x.tolist() for x in keys]), counts.tolist())) == want


def brute(rows, least, most):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    freq, sizes = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        f = freq.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            sizes[lang] += len(words)
            f.update(tuple(words[i:i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for lang, f in freq.items():
        f = {p: a for p, a in f.items() if a >= least}
        inside = {}
        for p, a in f.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside.get(p[i:i + m], 0), a)
        ranked = []
        for p, a in f.items():
            if len(p) > 1 and inside.get(p, 0) < a:
                score, _, left, right = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def mined(frame, **kw):
    return sorted(tuple(r) for r in co.mine_collocations(frame, **kw).collect())


SCHEMA = "lang string, text string, id long, word string, block long"


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"W{i}" if i % 3 else f"é{i}" for i in range(30)] + ["a\x01", "a", "New", "York"]
    fixed = ["New York city hall opened today", "once upon a time there was a", "a a a a a a a"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 30)):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else vocab[int(rng.random() ** 2 * len(vocab))])
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "\xa0", "\v"]))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(words), 1, "x", 2))
    return rows + [("en", None, 1, "x", 2), ("zz", "", 1, "x", 2), (None, " \t.", 1, "x", 2)] + rows[:3]


@pytest.mark.parametrize("seed, block, held, most", [(1, 1 << 22, 1 << 21, 2000), (2, 300, 50, 7), (3, 40, 3, 30)])
def test_phrases_like_plain_counting(spark, monkeypatch, seed, block, held, most):
    monkeypatch.setattr(co, "BLOCK", block)
    monkeypatch.setattr(co, "HELD", held)
    monkeypatch.setattr(co, "SLICE", 64)
    rows = corpus(seed, 400)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute([r[:2] for r in rows], 8, most)
    assert len(want) > 15
    assert mined(frame, least=8, most=most) == want


def test_a_full_pair_array_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "PAIR_BITS", 15)
    rows = corpus(4, 200)
    assert mined(spark.createDataFrame(rows, SCHEMA), least=4) == brute([r[:2] for r in rows], 4, 2000)


def test_nothing_and_one_long_text(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([("en", "few words", 1, "x", 1)], SCHEMA)) == []
    rows = [("en", "to be or not " * 100_000, 1, "x", 1), (None, "x" * 300_000, 1, "x", 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute([r[:2] for r in rows], 100, 2000)


def test_scores_beyond_64_bits():
    parts = [{"k": 1, "head": True, "f": 10 ** 11}, {"k": 1, "head": False, "f": 3 * 10 ** 11}]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "ids": [[1, 2]], "a": [10 ** 10], "n": [10 ** 13], "parts": [parts]})
    assert next(co._scored(iter([batch]))).to_pylist()[0]["score"] == 1000 * 10 ** 23 // (3 * 10 ** 22)
