"""B: edge cases of the column functions."""

import random
import re

import pytest
from helpers import frame, rows, ts
from pyspark.sql import functions as F

from pulsemill.functions import columns as c, text as x


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("unit,a,b,want", [
    ("hour", ts(0, minutes=59), ts(2, minutes=1), 2), ("hour", ts(0, minutes=1), ts(0, minutes=59), 0),
    ("hour", ts(2, minutes=1), ts(0, minutes=59), -2), ("minute", ts(0, seconds=59), ts(0, seconds=61), 1),
    ("day", ts(23.9), ts(24.1), 1), ("month", ts(0, days=30), ts(0, days=31), 1), ("year", ts(-1), ts(0), 1),
    ("second", ts(-1e6, microseconds=1), ts(-1e6, seconds=1), 1), ("millisecond", ts(0), ts(0, milliseconds=7), 7)])
def test_boundaries(spark, unit, a, b, want):
    assert one(spark, c.datediff_boundary(unit, F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))) == want


def test_keys_ignore_case_and_nulls_and_keep_parts_apart(spark):
    key = lambda *v, **kw: one(spark, c.hash_key(*[F.lit(p) for p in v], **kw))
    assert key("ab", "c") == key("AB", "C") and key("ab", "c") != key("a", "bc")
    assert key("ab", "c", compat=True) == key("a", "bc", compat=True)
    assert key("a", None) == key("a")
    with pytest.raises(ValueError):
        c.hash_key(*["a"] * 7)


def test_codes(spark):
    df = frame(spark, "v int", [(0,), (1,), (9,), (None,)])
    assert rows(df.select("v", c.decode("v", {0: "zero", 1: "one"}).alias("t"))) == [(0, "zero"), (1, "one"), (9, "?:9"), (None, None)]
    assert rows(df.select("v", c.yes_no(F.when(F.col("v") < 2, F.col("v"))).alias("t"))) == [(0, "No"), (1, "Yes"), (9, "N.A."), (None, "N.A.")]
    assert one(spark, c.display_text(F.lit("SOME_LONG_STATE"))) == "Some long state"


def test_texts(spark):
    assert one(spark, c.truncate_text(F.lit("abcdef"), 3, "...")) == "abc..." and one(spark, c.truncate_text(F.lit("abc"), 3)) == "abc"
    assert one(spark, c.strip_leading_lf(F.lit("\n\na\nb"))) == "\na\nb"
    assert one(spark, c.slice_text(F.lit("select 1; select 2"), F.lit(20), F.lit(-1))) == "select 2"
    assert one(spark, c.slice_text(F.lit("select 1; select 2"), F.lit(0), F.lit(14))) == "select 1"
    assert one(spark, c.quote_path(F.lit("a]b"), F.lit("c"))) == "[a]]b].[c]"
    assert one(spark, c.hex_key(F.lit(bytearray(b"\x01\xff")))) == "0x01FF"
    kv = one(spark, c.parse_kv(F.lit("@a = 1; @b='x y' ; junk; @a=2;@c=p=q")))
    assert kv == {"@a": "2", "@b": "x y", "@c": "p=q"}
    assert [one(spark, c.safe_int(F.lit(v))) for v in ("12", " 7 ", "1.5", "-1", "", "9" * 30)] == [12, 7, None, None, None, None]


def test_packed_times(spark):
    assert one(spark, c.packed_datetime(F.lit(20240229), F.lit(235901))) == ts(24 * 59 + 23, minutes=59, seconds=1)
    assert one(spark, c.packed_datetime(F.lit(20240230), F.lit(0))) is None
    assert one(spark, c.packed_duration(F.lit(300102))) == 30 * 3600 + 62
    assert one(spark, c.pack_duration(F.lit(30 * 3600 + 62))) == 300102


def test_arithmetic(spark):
    assert [one(spark, c.at_least_one(F.lit(v).cast("int"))) for v in (0, 5, None)] == [1, 5, 1]
    assert one(spark, c.safe_ratio(F.lit(1), F.lit(0))) is None and one(spark, c.safe_ratio(F.lit(0), F.lit(4), lift_zero=True)) == 0.25
    assert one(spark, c.other_share(F.lit(30), F.lit(25))) == 45


def test_pattern_lists(spark):
    df = frame(spark, "n string, system boolean", [("master", True), ("tmp_1", False), ("tmpx1", False), ("a", False), ("B%", False)])
    pick = lambda spec: rows(x.select_by_patterns(df, "n", spec, {"USER": ~F.col("system")}), "n", "match_position")
    assert pick("USER, -tmp%, master") == [("B%", 1), ("a", 1), ("master", 3)]
    assert pick("A ,tmp_1\n") == [("a", 1), ("tmp_1", 2)]
    assert pick("[b%]") == [("B%", 1)] and pick("-a") == [] and len(pick("ALL")) == 5


def _table(spark, items):
    return frame(spark, "position int, pattern string", list(enumerate(items, 1)))


def test_pattern_table_equals_list(spark):
    df = frame(spark, "n string, system boolean", [("master", True), ("tmp_1", False), ("tmpx1", False), ("a", False), ("B%", False), ("a\\\\b", None), ("", False), ("a", True)])
    classes = {"user": ~F.col("system")}
    for spec in ("USER, -tmp%, master", "A ,tmp_1\n", "[b%]", "-a", "ALL", "%", "%a%", "%s%e%", "tmp%1, -%_%", "ALL, -USER", "a\\\\%", "%t%r, m%r", "ma%aster", "m%s%r,-MASTER", " , ,a"):
        want = rows(x.select_by_patterns(df, "n", spec, classes).filter("match_position IS NOT NULL"), "n", "match_position")
        assert rows(x.select_by_pattern_table(df, "n", _table(spark, spec.split(",")), classes=classes), "n", "match_position") == want, spec


def test_pattern_table_of_many_items(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abc") for _ in range(rng.randint(0, most)))
    names = [word(7) for _ in range(400)] + ["abc"] * 300 + [None] * 3
    items = [None, ""] + [rng.choice(["", "", "-"]) + "%".join(word(3) for _ in range(rng.randint(1, 4))) for _ in range(60)] + [f"none{i}%{i}" for i in range(10_000)]
    items = [i for i in items if i is None or i.strip("-%")]
    got = x.select_by_pattern_table(frame(spark, "n string, _in int", [(n, 0) for n in names]), "n", _table(spark, items))
    fit = lambda n, p: re.fullmatch(".*".join(map(re.escape, p.split("%"))), n) is not None
    want = []
    for n in names:
        if n is None:
            continue
        at = [k for k, p in enumerate(items[:70], 1) if p and not p.startswith("-") and fit(n, p)]
        if at and not any(fit(n, p[1:]) for p in items[:70] if p and p.startswith("-")):
            want.append((n, min(at)))
    assert got.columns == ["n", "_in", "match_position"] and rows(got, "n", "match_position") == sorted(want) and want
    empty = frame(spark, "position int, pattern string", [])
    assert x.select_by_pattern_table(frame(spark, "n string", [("a",)]), "n", empty).count() == 0


def test_range_texts(spark):
    t = lambda right: one(spark, c.range_text(F.lit("x"), F.lit(5), F.lit(None), F.lit(9), F.lit(right)))
    assert t(False) == "x > Infinity and x <= 5" and t(True) == "x >= 5 and x < 9"


def test_command_kinds(spark):
    k = lambda kind, text: one(spark, c.classify_command(F.lit(kind), F.lit(text)))
    assert k("ALTER_INDEX", "ALTER INDEX i REBUILD WITH") == 1 and k("ALTER_INDEX", "ALTER INDEX i SET") is None and k("xp_delete_file", None) == 9
