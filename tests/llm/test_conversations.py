"""Conversation repair against a search over whole edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pulsemill.llm import conversations as conv

GOAL = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(rows):
    """The report of one conversation's (turn, role, text) rows in order, by Dijkstra over (row, roles so far)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i < len(rows):
            _, role, text = rows[i]
            cut = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and role[:1] in nexts:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in nexts:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, new[0], (*out, f"{new}:{text}")))
        for new in ("user", "assistant"):
            if new[0] in nexts:
                heapq.heappush(heap, (cost + 2, audit + "I", i, new[0], (*out, f"{new}:")))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def grouped(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, id string, part long"


def check(frame, ids=None):
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute(v) for c, v in grouped(rows).items()}
    got = {r.conv_id: r.asDict() for r in conv.repair_conversations(frame, ids=ids).collect()}
    for c, w in want.items():
        assert {k: got[c][k] for k in w} == w, c
    return got, want


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?  ", "a. b", None, "é…", "Same."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    out = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.1 else t + 3 * (rng.random() < 0.1)
            out.append((c if c else None, turn, rng.choice(roles[:rng.choice([2, 3, 9])]), rng.choice(texts) if rng.random() < 0.5 else f"Text {c} {t}.", "x", 9))
    return out + out[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_a_search(spark, seed):
    rows = random_rows(seed, 120, 12)
    got, want = check(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert len(got) == len(want)


def test_conversations_cut_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conv, "CHUNK_BITS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        check(spark.createDataFrame(random_rows(3, 3, 150) + random_rows(4, 40, 6), SCHEMA).repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_repaired_turns_hash_to_the_report(spark):
    frame = spark.createDataFrame(random_rows(5, 60, 10), SCHEMA)
    rows = {}
    for r in sorted(conv.repaired_turns(frame).collect(), key=lambda r: (str(r.conv_id), r.row)):
        rows.setdefault(r.conv_id, []).append(r)
    for r in conv.repair_conversations(frame).collect():
        mine = rows.get(r.conv_id, [])
        assert [x.row for x in mine] == list(range(1, len(mine) + 1))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == r.repaired_sha256
        assert GOAL.fullmatch("".join(x.role[0] for x in mine))
        assert "".join(x.edit for x in mine) == r.audit.replace("D", "")


def test_damage(spark):
    rows = [(c, t, "assistant", "A b. C!", "x", 1) for c in range(40) for t in range(5)] + [(None, None, None, None, "x", 1)]
    want = []
    for c, t, r, x, _, _ in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        k, r, x = zlib.crc32(key.encode()) % 20, " " if r is None else r, " " if x is None else x
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in conv.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nothing_and_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conv.repair_conversations(none).count() == 0 and conv.repaired_turns(none).count() == 0
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    got = conv.repair_conversations(none, ids=ids).collect()
    assert [(r.audit, r.cost, r.repaired_sha256) for r in got] == [("", 0, EMPTY)] * 2
    check(spark.createDataFrame([(1, 0, "user", "word " * 200_000 + ".", "x", 1), (1, 1, "assistant", " " * 300_000, "x", 1)], SCHEMA))


def test_hot_conversation_of_equal_rows(spark):
    rows = spark.range(30_000).selectExpr("7L as conv_id", "cast(id % 2 as long) as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "'Hi.' as text")
    r = conv.repair_conversations(rows).collect()[0]
    assert (r.duplicate, r.gaps, r.cost) == (29_998, 0, 3 * 29_998)
    assert r.audit == "K" + "D" * 14_999 + "K" + "D" * 14_999


def test_suffixes_share_classes():
    machine = conv.Automaton()
    rng = random.Random(6)
    for _ in range(300):
        node = 0
        for _ in range(200):
            node = machine.step(conv.symbol_of(rng.choice("suao"), rng.choice(conv.FAULTS)), node)
    assert len(machine.values) < 400


def test_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got, _ = check(conv.damage(frame), ids=frame.select("conv_id"))
    assert set(got) == {r.conv_id for r in frame.select("conv_id").distinct().collect()}
