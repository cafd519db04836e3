"""Exact dedup, SimHash, line dedup and components against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from pulsemill.llm import components as components_module
from pulsemill.llm import exact_dedup, line_dedup, simhash
from pulsemill.llm.common import stored
from pulsemill.llm.components import components


def joined(nodes, links):
    """Smallest member of the class of each node."""
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("counters", [1, 4, 1024])
def test_exact_dedup_is_brute_force(docs_of, counters):
    rng = random.Random(1)
    texts = ["", None, "a b", "ab", "a  b\n", "é", "x" * 500] + [f"t {i}" for i in range(20)]
    pairs = [(i, rng.choice(texts[:4] if rng.random() < 0.6 else texts)) for i in range(300)] + [(7, "ab"), (7, "ab")]
    want = defaultdict(list)
    for i, t in pairs:
        want[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    got = exact_dedup.exact_dedup(docs_of(pairs), counters=counters).collect()
    assert len(got) == len(pairs)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    kept = defaultdict(int)
    for r in got:
        group = by_digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(group)[1], len(group))
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_misra_gries_finds_every_frequent_digest(spark):
    rng = random.Random(2)
    values = ["hot"] * 300 + ["warm"] * 90 + [f"v{rng.randrange(10_000)}" for _ in range(600)]
    rng.shuffle(values)
    frame = spark.createDataFrame([(v,) for v in values], "digest string").repartition(7)
    found = {r.digest for r in exact_dedup.frequent_digests(frame, counters=12).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 13


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 900)] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(400)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links if a != b]
    want = joined({n for e in links for n in e}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, words=3):
    parts = [p for p in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if p]
    shingles = [" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    texts = [None, "", " \n", "One", "one two", "One TWO three four\tfive", "Ä é ß\x0bx y z   w", "a a a a a a a"]
    assert [int(x) & (1 << 64) - 1 for x in simhash.fingerprints(texts)] == [plain_fingerprint(t) for t in texts]


def test_shingle_hash_is_sparks(spark):
    got = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_ring_never_loses_a_pair():
    rng = random.Random(4)
    masks = simhash.chain_keys()
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(3))})
        assert simhash.on_ring(np.array([x ^ y], np.uint64))[0]
        assert any(x & m == y & m for m in masks)
    far = [rng.getrandbits(64) for _ in range(1000)]
    assert simhash.on_ring(np.array(far, np.uint64)).sum() < 5


@pytest.mark.parametrize("cap", [2, 64])
def test_links_connect_like_all_pairs(spark, monkeypatch, cap):
    rng = random.Random(5)
    fps = set()
    for size in (1, 1, 2, 5, 40, 200):
        seed = rng.getrandbits(64)
        spots = rng.sample(range(64), 12)
        for _ in range(size):
            fps.add(seed ^ sum(1 << b for b in rng.sample(spots, rng.randrange(4))))
    signed = [simhash._signed(x) for x in fps]
    links = [(simhash._signed(a), simhash._signed(b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    want = joined(signed, links)
    monkeypatch.setattr(simhash, "CAP", cap)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = dict.fromkeys(signed)
    got.update({r.fp: r.root for r in simhash.classes(frame).collect()})
    assert {n: got[n] if got[n] is not None else n for n in signed} == want


def test_buckets_stream_over_batches():
    rng = random.Random(6)
    rows = sorted((0, k, rng.getrandbits(62)) for k in range(40) for _ in range(rng.choice([1, 2, 3, 150])))
    def batches(size):
        for a in range(0, len(rows), size):
            part = rows[a:a + size]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()),
                                              pa.array([r[2] for r in part], pa.int64())], names=["mask", "key", "fp"])
    def large(size):
        return sorted(a for b in simhash._bucket_links(batches(size)) for a, o in zip(b["a"].to_pylist(), b["b"].to_pylist()) if o is None)
    want = sorted(r[2] for k, g in itertools.groupby(rows, lambda r: r[1]) for g in [list(g)] if len(g) > simhash.CAP for r in g)
    assert large(10**6) == large(37) == large(100) == want


def test_near_duplicates_and_their_stage(docs_of):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(12)]
    texts = base + [base[0], base[0].upper(), base[1] + " more", base[2].replace(" ", "\n"), "", None, "\t", "w1", "w1 w2"]
    pairs = list(enumerate(texts)) + [(3, texts[3])]
    prints = {i: plain_fingerprint(t) for i, t in pairs}
    want = joined(list(prints), [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    docs = stored(docs_of(pairs), "t")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == sorted(set(want.values()))


def jaccard(x, y, k=line_dedup.SHINGLE):
    a, b = ({s[i:i + k] for i in range(len(s) - k + 1)} or {s} for s in (x, y))
    return len(a & b) / len(a | b)


def line_texts(rng, groups):
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    out = []
    for size in groups:
        base = rng.choices(words, k=40)
        for _ in range(size):
            line = list(base)
            for _ in range(rng.randrange(3)):
                line[rng.randrange(40)] = rng.choice(words)
            out.append(" ".join(line).capitalize())
    return out


@pytest.mark.parametrize("cap,block", [(16, 256), (2, 8)])
def test_lines_like_brute_force(docs_of, monkeypatch, cap, block):
    """With a low cap and small blocks, the way for large buckets does the work; results stay."""
    monkeypatch.setattr(line_dedup, "CAP", cap)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(8)
    lines = line_texts(rng, [1, 1, 2, 6, 30, 60])
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 3] + ["short"]) for i in range(0, len(lines), 3)]
    pairs = list(enumerate(texts)) + [(900, texts[0].upper()), (901, None)]
    docs = stored(docs_of(pairs), "t")
    got = line_dedup.judge_lines(docs).collect()
    place = {(i, k): line_dedup.normalise(x) for i, t in pairs for k, x in enumerate((t or "").split("\n")) if len(line_dedup.normalise(x)) >= line_dedup.MIN_CHARS}
    assert {(r.doc_id, r.line_no) for r in got} == set(place)
    alike = {(a, b): jaccard(place[a], place[b]) for a, b in itertools.combinations(sorted(place), 2)}
    classes = defaultdict(set)
    for r in got:
        classes[r.component].add((r.doc_id, r.line_no))
    mine = {n: min(c) for c in classes.values() for n in c}
    # No class joins what links don't; and what is alike is together.
    want = joined(sorted(place), [p for p, x in alike.items() if x >= 0.8])
    assert all(want[n] == want[top] for n, top in mine.items())
    assert all(mine[a] == mine[b] for (a, b), x in alike.items() if x >= 0.8)
    wanted = set(mine.values())
    assert {(r.doc_id, r.line_no) for r in got if r.kept} == wanted
    for r in line_dedup.drop_copied_lines(docs).collect():
        if r.doc_id == 901:
            assert r.text is None
            continue
        old = dict(pairs)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(old) if (r.doc_id, k) not in place or (r.doc_id, k) in wanted)
        assert r.n_chars == len(r.text)


def odd_lines(rng):
    """Lines of all lengths, with pairs on both sides of 0.8: edited, cut, lengthened, repeating, shorter than a shingle."""
    out = ["a" * k for k in range(1, 40)] + ["ab" * k for k in range(1, 20)]
    for size in [3, 8, 9, 10, 11, 12, 14, 17, 19, 22, 28, 36, 40, 46, 60, 75, 120, 140, 200, 300, 700, 1500]:
        for _ in range(4):
            base = "".join(rng.choices("abcdefgh ", k=size))
            out.append(base)
            for _ in range(5):
                line = list(base)
                for _ in range(rng.randrange(1, max(2, size // 60))):
                    line[rng.randrange(len(line))] = rng.choice("xyz")
                out += ["".join(line), base[:int(size * rng.uniform(0.75, 1))], base + "".join(rng.choices("xyz", k=int(size * rng.uniform(0, 0.25))))]
    return out


def linked_lines(lines, similarity=0.8):
    """Pairs of different lines whose sets of shingles link, by all pairs."""
    sets = {x: {x[i:i + line_dedup.SHINGLE] for i in range(len(x) - line_dedup.SHINGLE + 1)} or {x} for x in lines}
    return [(x, y) for x, y in itertools.combinations(sorted(sets), 2)
            if 1000 * len(sets[x] & sets[y]) >= round(1000 * similarity) * len(sets[x] | sets[y])]


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.5])
def test_linked_lines_share_keys(similarity):
    """Never a link without a key in common, or TIMES of the frequent kind, but for lines that are named."""
    rng = random.Random(9)
    lines = sorted({line_dedup.normalise(x) for x in odd_lines(rng)} - {""})
    levels = line_dedup.levels_of(lines[::3])
    owner, key, few = line_dedup.line_keys(lines, similarity, levels)
    keys = defaultdict(set)
    for o, k in zip(owner.tolist(), key.tolist()):
        keys[lines[o]].add(k)
    few = {lines[i] for i in few.tolist()}
    often = 1 << line_dedup._KEY
    links = linked_lines(lines, similarity)
    assert len(links) > 300
    for x, y in links:
        both = keys[x] & keys[y]
        assert {x, y} & few or any(k < often for k in both) or len(both) >= line_dedup.TIMES
    if similarity == 0.8:
        assert not few


@pytest.mark.parametrize("cap,small,similarity", [(16, 32, 0.8), (1, 32, 0.8), (16, 2, 0.8), (4, 32, 0.6)])
def test_no_link_of_lines_is_lost(docs_of, monkeypatch, cap, small, similarity):
    """Components are those of all pairs, for short lines too; with a low cap by way of long lists, with small groups by way of prefixes."""
    monkeypatch.setattr(line_dedup, "CAP", cap)
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rng = random.Random(12)
    lines = odd_lines(rng)
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 5]) for i in range(0, len(lines), 5)] + [None, "", "aaaa\nAAAA"]
    got = line_dedup.judge_lines(stored(docs_of(list(enumerate(texts))), "t"), similarity=similarity).collect()
    place = {(i, k): line_dedup.normalise(x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if line_dedup.normalise(x)}
    assert {(r.doc_id, r.line_no) for r in got} == set(place)
    root = joined(sorted(set(place.values())), linked_lines(set(place.values()), similarity))
    classes = defaultdict(set)
    for p, x in place.items():
        classes[root[x]].add(p)
    mine = defaultdict(set)
    for r in got:
        mine[r.component].add((r.doc_id, r.line_no))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, classes.values()))
    assert {(r.doc_id, r.line_no) for r in got if r.kept} == {min(c) for c in classes.values()}
    assert all(r.component_size == len(mine[r.component]) for r in got)


def test_copies_of_a_line_in_many_tasks_are_one(docs_of, monkeypatch):
    """Lines that each task meets have keys and pairs once, and only lines with a pair are taken out to be compared."""
    rng = random.Random(15)
    lines = line_texts(rng, [1, 1, 3, 4])
    docs = stored(docs_of([(i, "\n".join(rng.sample(lines, len(lines)))) for i in range(24)], parts=12), "t")
    seen = {}

    def keep(df, label, *rest):
        out = stored(df, label, *rest)
        if label in ("lines", "candidates", "pairs", "paired-lines"):
            seen.setdefault(label, out.collect())
        return out

    monkeypatch.setattr(line_dedup, "stored", keep)
    line_dedup.judge_lines(docs).collect()
    hashes = {r.no: r.hash for r in seen["lines"] if r.no is not None}
    assert len(hashes) > len(set(hashes.values())) == len(set(lines))
    found = [(r.a, r.b) for r in seen["candidates"] if r.b is not None]
    assert found and all(hashes[a] != hashes[b] for a, b in found if a != b)
    assert {r.no for r in seen["paired-lines"]} == {no for r in seen["pairs"] for no in (r.a, r.b)}


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_components_by_one_task_or_by_stars(spark, monkeypatch, most):
    monkeypatch.setattr(components_module, "EDGES", most)
    rng = random.Random(16)
    links = [(i + 1, i) for i in range(300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)] + [(950, 950), (-(1 << 62), 1 << 62)]
    want = joined({n for a, b in links if a != b for n in (a, b)}, [(a, b) for a, b in links if a != b])
    rows = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
    nodes, roots = components_module.roots_of(*(np.array(x) for x in zip(*links)))
    assert {a: b for a, b in zip(nodes.tolist(), roots.tolist()) if a != 950} == want


@pytest.mark.parametrize("most", [1 << 13, 64])
def test_parity_never_parts_linked_lines(monkeypatch, most):
    """Bits of parity, folded to fewer words too, let every link pass, and tell most other lines apart."""
    monkeypatch.setattr(line_dedup, "PARITY", most)
    rng = random.Random(17)
    lines = sorted({line_dedup.normalise(x) for x in odd_lines(rng)} - {""})[:450]
    signs = pa.Table.from_batches(line_dedup._signed([pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], names=["no", "text"])])).to_pylist()
    sets = [{x[i:i + line_dedup.SHINGLE] for i in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for x in lines]
    assert [s["n"] for s in signs] == [len(x) for x in sets] and [s["no"] for s in signs] == list(range(len(lines)))
    for similarity in (0.8, 0.5):
        passed = 0
        for a, b in itertools.combinations(range(len(lines)), 2):
            x, y = sorted((np.frombuffer(signs[i]["parity"], np.uint64) for i in (a, b)), key=len)
            near = line_dedup._near(x, line_dedup._folded(y[None], len(x))[0], len(sets[a]), len(sets[b]), similarity)
            assert near or len(sets[a] & sets[b]) < similarity * len(sets[a] | sets[b])
            passed += near
        assert passed < 0.2 * len(lines) ** 2 / 2 or most == 64 or similarity < 0.8


@pytest.mark.parametrize("block", [4096, 16])
def test_a_family_of_lines_makes_few_pairs(docs_of, monkeypatch, block):
    """Of lines that share much, but not enough, only those that may link are paired, though long lists hold them all."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(18)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(3000)]
    base = rng.choices(words, k=60)
    lines = [" ".join(base[:42] + rng.sample(words, 18)) for _ in range(150)]
    lines += [x + " more" for x in lines[::10]]
    docs = stored(docs_of([(i, x) for i, x in enumerate(lines)], parts=4), "t")
    pairs = []

    def keep(df, label, *rest):
        out = stored(df, label, *rest)
        pairs.extend(out.collect() if label in ("pairs", "across") else [])
        return out

    monkeypatch.setattr(line_dedup, "stored", keep)
    got = line_dedup.judge_lines(docs).collect()
    root = joined(lines, linked_lines(set(lines)))
    classes, mine = defaultdict(set), defaultdict(set)
    for i, x in enumerate(lines):
        classes[root[x]].add(i)
    for r in got:
        mine[r.component].add(r.doc_id)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, classes.values())) and len(classes) == 150
    assert len(pairs) < 10 * len(lines)


@pytest.mark.parametrize("words", [1 << 21, 0])
def test_lines_are_picked_by_their_bits(spark, monkeypatch, words):
    monkeypatch.setattr(line_dedup, "WORDS", words)
    nos = [(t << 33) + i for t in range(3) for i in range(200)]
    want = {no for no in nos if no % 7 == 0 or no % 64 == 63}
    texts = spark.createDataFrame([(no, str(no)) for no in nos], "no long, text string")
    some = texts.filter("no % 7 = 0 or no % 64 = 63").select("no")
    assert sorted(r.no for r in line_dedup._picked(texts, some).collect()) == sorted(want)
    rest = line_dedup._picked(texts, some, False)
    assert rest.columns == texts.columns and sorted(r.no for r in rest.collect()) == sorted(set(nos) - want)


def test_lists_of_lines_stream_over_batches():
    rng = random.Random(10)
    sizes = [rng.choice([1, 2, 5, 90]) for _ in range(30)]
    rows = [(b << 19 if k % 2 else b, k, rng.getrandbits(15)) for b in range(3) for k, n in enumerate(sizes) for _ in range(n)]
    blobs = []
    for bucket in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == bucket]
        rng.shuffle(mine)
        for a in range(0, len(mine), 7):
            some = sorted(mine[a:a + 7], key=lambda r: r[2])
            own = np.array([r[2] for r in some])
            assert (line_dedup._unstepped(line_dedup._steps(own)) == own).all()
            blobs.append((bucket, 0, line_dedup._steps(own), b"".join(r[1].to_bytes(3, "little") for r in some)))

    def run(size):
        def batches():
            for a in range(0, len(blobs), size):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blobs[a:a + size]), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                 names=["bucket", "base", "own", "keys"])
        return [x for b in line_dedup._met(batches()) for x in zip(*(b[c].to_pylist() for c in ("a", "b", "list", "times")))]

    assert run(10**6) == run(1) == run(4)
    lists = defaultdict(list)
    for b, k, no in rows:
        lists[b, k].append(no)
    short = {p for (b, k), g in lists.items() if len(g) <= line_dedup.CAP for p in itertools.combinations(sorted(set(g)), 2)}
    got = run(3)
    assert short <= {(a, b) for a, b, _, _ in got if b is not None}
    assert sorted((b << 24 | k, no) for (b, k), g in lists.items() if len(g) > line_dedup.CAP for no in g) == sorted((x, b) for _, b, x, _ in got if x is not None)


def word_sets(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i:i + words]) for i in range(len(parts) - words + 1)} or {tuple(parts)}


def edited(rng, words, text):
    """A copy with a few words replaced, so that similarities lie on both sides of 0.8."""
    parts = text.split()
    for _ in range(rng.randrange(1, max(2, len(parts) // 25))):
        parts[rng.randrange(len(parts))] = rng.choice(words)
    return " ".join(parts)


def test_the_stage_keeps_one_document_of_each_simhash_class(spark, docs_of):
    """Against all pairs of fingerprints: the least id of each class stays, null ids last."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    texts = ["", None, " \n", "w1", "W1 ", "w1 w2"]
    for _ in range(12):
        base = rng.choices(words, k=300)
        texts += [" ".join(base), " ".join(base) + " ", " ".join([*base[:150], rng.choice(words), *base[150:]])]
    pairs = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])]
    fp = simhash.fingerprints(texts).view(np.uint64)
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if int(fp[a] ^ fp[b]).bit_count() <= 2]
    want = sorted(set(joined(range(len(texts)), near).values()))
    docs = stored(docs_of(pairs), "t")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.dtypes == docs.dtypes and sorted(r.doc_id for r in got.collect()) == want


def test_short_lines_are_compared_too(docs_of):
    """Lines under 20 characters lose their exact and their near copies, like any others."""
    texts = ["Yes\nA line that is long enough to be banded", "yes \n\n}\nabcdefghij klmnopq", "}\nabcdefghij klmnopr\n \n yes", "}", None, ""]
    docs = stored(docs_of(list(enumerate(texts))), "t")
    got = {(r.doc_id, r.line_no): r for r in line_dedup.judge_lines(docs).collect()}
    lines = {(i, k): line_dedup.normalise(x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip()}
    assert set(got) == set(lines)
    for place, line in lines.items():
        same = sorted(p for p, x in lines.items() if x[:17] == line[:17])
        assert got[place].line_hash == line_dedup.line_hash(line)
        assert got[place].component == min(line_dedup.line_hash(lines[p]) for p in same)
        assert (got[place].kept, got[place].component_size) == (place == same[0], len(same))
    left = {r.doc_id: r.text for r in line_dedup.drop_copied_lines(docs).collect()}
    assert left == {0: texts[0], 1: "\n}\nabcdefghij klmnopq", 4: None, 5: ""}


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, line_dedup.drop_copied_lines])
def test_rows_keep_their_numbers_when_files_are_split_anew(spark, docs_of, drop):
    """Between finding what goes and reading what stays, the scan is cut differently, as when executors come or go."""
    rng = random.Random(13)
    words = [f"word{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(30)]
    pairs = [(i, t) for i, t in enumerate(texts + texts)]
    docs = stored(docs_of(pairs, parts=12), "t")
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 64 << 20)
        out = drop(docs)
        spark.conf.set(key, 0)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
        assert sorted((r.doc_id, r.text) for r in out.collect()) == pairs[:30]
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
