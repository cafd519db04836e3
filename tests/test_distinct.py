"""Distinct counts from states that merge."""

import random

import pytest
from helpers import frame, rows

from pulsemill.operators import aggregate


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(3)
    edges = [None, 0, -1, -32768, -32769, 32768, 32769, 1 << 40]
    data = [(rng.choice("ab"), rng.randrange(4), rng.choice([*edges, rng.randrange(-99, 99), rng.randrange(10**6)])) for _ in range(800)] + [("c", 0, None)]
    return frame(spark, "kind string, day int, v bigint", data), data


def plain(data, *dims):
    sets = {}
    for r in data:
        if r[2] is not None:
            sets.setdefault(tuple(r[d] for d in dims), set()).add(r[2])
    return sorted((*k, len(v)) for k, v in sets.items())


def test_any_grouping_of_a_state(spark, facts):
    df, data = facts
    early, late = df.filter("day < 2 OR v % 2 = 0"), df.filter("day >= 1")
    state = aggregate.merge_distinct(aggregate.distinct_state(early, "v", ["kind", "day"]), ["kind", "day"], aggregate.distinct_state(late, "v", ["kind", "day"]))
    state = spark.createDataFrame(state.collect(), state.schema)
    assert rows(aggregate.distinct_from_state(state, "n", ["kind", "day"])) == plain(data, 0, 1)
    assert rows(aggregate.distinct_from_state(state, "n", "kind")) == plain(data, 0)
    assert rows(aggregate.distinct_from_state(state, "n")) == plain(data)
    assert rows(aggregate.distinct_from_state(aggregate.merge_distinct(state, "day"), "n", "day")) == plain(data, 1)


def test_sketches(facts):
    df, data = facts
    state = aggregate.distinct_state(df, "v", ["kind", "day"], approximate=True)
    for (kind, n), (same, want) in zip(rows(aggregate.distinct_from_state(state, "n", "kind")), plain(data, 0)):
        assert kind == same and abs(n - want) <= 0.05 * want
    assert aggregate.distinct_from_state(state.limit(0), "n", "kind").count() == 0
