"""Lists and descriptions in text."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .columns import as_col, bitmask_labels, unpack_date, unpack_seconds

# Weekday bits of a weekly schedule, Monday first.
WEEKDAY_BITS = {2: "Mon", 4: "Tue", 8: "Wed", 16: "Thu", 32: "Fri", 64: "Sat", 1: "Sun"}
# Recurrence and sub-day codes of a schedule.
FREQ_ONCE, FREQ_DAILY, FREQ_WEEKLY, FREQ_MONTHLY, FREQ_MONTHLY_RELATIVE = 1, 4, 8, 16, 32
SUBDAY_UNITS = {2: "second", 4: "minute", 8: "hour"}
OPEN_END_DATE = 99991231


def split_part_table(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """One row per part, with its number (from 1) and trimmed text."""
    pieces = F.split(F.col(col), re.escape(sep))
    return (df.select("*", F.posexplode(pieces).alias("part_no", "part"))
            .withColumns({"part_no": F.col("part_no") + 1, "part": F.trim("part")}))


def _pattern_test(col: Column, item: str, classes: Mapping[str, Column]) -> Column:
    if item.upper() in classes:
        return classes[item.upper()]
    if item.startswith("[") and item.endswith("]"):
        item = item[1:-1].replace("]]", "]")
    # '%' is the only wildcard; '_' and '\' stand for themselves.
    like = item.upper().replace("\\", "\\\\").replace("_", "\\_")
    return F.upper(col).like(like)


def select_by_patterns(df: DataFrame, col: str, spec: str,
                       classes: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows whose name a list like ``'USER, -tmp%, [a]'`` selects.

    A leading '-' excludes and excludes win; ``classes`` maps class words to
    predicates, and 'ALL' is always known.  ``match_position`` (from 1) is
    the first list item that includes the row, so callers can order by it
    and the name.
    """
    classes = {"ALL": F.lit(True), **{k.upper(): v for k, v in (classes or {}).items()}}
    items = [i.strip() for i in re.sub(r"[\r\n]", "", spec).split(",")]
    name = F.col(col)
    included = [F.when(_pattern_test(name, item, classes), F.lit(pos))
                for pos, item in enumerate(items, 1) if item and not item.startswith("-")]
    excluded = [_pattern_test(name, item[1:], classes) for item in items if item.startswith("-")]
    position = F.coalesce(*included) if included else F.lit(None).cast("int")
    out = df.withColumn("match_position", position).filter("match_position IS NOT NULL")
    if excluded:
        out = out.filter(~reduce(Column.__or__, excluded))
    return out


#: Characters of the longest inner fragment of a pattern by which names are looked up.
GRAM = 3


def _pattern_keys(patterns: DataFrame) -> DataFrame:
    """Patterns by what a name must have: text before the first '%', text after the last, a gram of what lies between.

    ``_like`` is null where these say it all.
    """
    text = F.when(F.col("_p").startswith("[") & F.col("_p").endswith("]"),
                  F.replace(F.expr("substring(_p, 2, length(_p) - 2)"), F.lit("]]"), F.lit("]"))).otherwise(F.col("_p"))
    split = patterns.select("_out", "_at", F.split(F.upper(text), "%").alias("_parts"))
    between = F.filter(F.slice("_parts", 2, F.greatest(F.size("_parts") - 2, F.lit(0))), lambda x: x != "")
    longest = F.aggregate("_between", F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    escaped = F.replace(F.replace(F.array_join("_parts", "%"), F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_"))
    exact = F.size("_parts") == 1
    return (split.withColumn("_between", between).groupBy(
        exact.alias("_exact"), F.element_at("_parts", 1).alias("_prefix"),
        F.when(exact, "").otherwise(F.element_at("_parts", -1)).alias("_suffix"),
        F.substring(longest, 1, GRAM).alias("_gram"),
        F.when(F.size("_between") > 0, escaped).alias("_like"))
        .agg(F.min(F.when(~F.col("_out"), F.col("_at"))).alias("_in"), F.max("_out").alias("_gone")))


def select_by_pattern_table(df: DataFrame, col: str, patterns: DataFrame, pattern: str = "pattern",
                            position: str = "position", classes: Mapping[str, Column] | None = None) -> DataFrame:
    """B19 for lists of any length: as ``select_by_patterns``, with the list's items as rows of a table.

    Different names meet the patterns in an equi join.  A pattern's key is its
    text before the first '%', that after the last and up to three characters
    of its longest text between; a name has one key for each combination of
    lengths in the list, and each of its substrings where there is text
    between.  Only patterns with such text are compared with LIKE.

    ``match_position`` is the least position of an item that includes the row.
    Null and blank items count for nothing; a null name fits class words only.
    An excluding class word whose test is null excludes.
    """
    classes = {"ALL": F.lit(True), **{k.upper(): v for k, v in (classes or {}).items()}}
    text = F.regexp_replace(F.regexp_replace(F.col(pattern), "[\\r\\n]", ""), "^\\s+|\\s+$", "")
    out = F.col("_p").startswith("-")
    items = (patterns.select(text.alias("_p"), F.col(position).alias("_at")).filter(F.col("_p") != "")
             .select(out.alias("_out"), F.when(out, F.expr("substring(_p, 2)")).otherwise(F.col("_p")).alias("_p"), "_at"))
    is_word = F.upper("_p").isin(list(classes))
    keyed, words = _pattern_keys(items.filter(~is_word)), items.filter(is_word)

    shape = F.struct("_exact", F.length("_prefix").alias("p"), F.length("_suffix").alias("s"), F.length("_gram").alias("g"))
    size = F.length("_name")
    fits = lambda x: F.when(x["_exact"], x["p"] == size).otherwise(x["p"] + x["s"] + x["g"] <= size)
    grams = F.when(F.col("g") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(
        F.sequence(F.lit(1), size - F.col("g") + 1), lambda at: F.substring(F.col("_name"), at, F.col("g")))))
    names = (df.select(F.upper(col).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
             .withColumn("_shapes", keyed.select(F.collect_set(shape)).scalar())
             .select("_name", F.inline(F.filter("_shapes", fits)))
             .select("_name", "_exact", F.expr("left(_name, p)").alias("_prefix"), F.expr("right(_name, s)").alias("_suffix"),
                     F.explode(grams).alias("_gram")))
    found = (names.join(keyed, ["_exact", "_prefix", "_suffix", "_gram"]).filter("_like IS NULL OR _name LIKE _like")
             .groupBy(F.col("_name").alias("_pattern_name"))
             .agg(F.struct(F.min("_in").alias("at"), F.max("_gone").alias("gone")).alias("_pattern_hit")))

    def said(word: str, excludes: bool, value: Column) -> Column:
        return words.filter((F.upper("_p") == word) & (F.col("_out") == excludes)).select(value).scalar()

    some = F.count(F.lit(1)) > 0
    included = F.least(F.col("_pattern_hit.at"), F.lit(None), *[F.when(test, said(w, False, F.min("_at"))) for w, test in classes.items()])
    excluded = reduce(Column.__or__, [F.coalesce("_pattern_hit.gone", F.lit(False)),
                                      *[test & said(w, True, some) for w, test in classes.items()]])
    return (df.join(found, F.upper(F.col(col)) == F.col("_pattern_name"), "left")
            .select(*[F.col(c) for c in df.columns], included.alias("match_position"), excluded.alias("_pattern_out"))
            .filter("match_position IS NOT NULL AND NOT _pattern_out").drop("_pattern_out"))


def _clock(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")


def schedule_text(freq_type="freq_type", freq_interval="freq_interval", subday_type="subday_type",
                  subday_interval="subday_interval", recurrence="recurrence",
                  start_date="start_date", end_date="end_date",
                  start_time="start_time", end_time="end_time") -> dict[str, Column]:
    """Recurrence in words: which days, at what times, in which period."""
    ft, fi, st, si, rec = map(as_col, (freq_type, freq_interval, subday_type, subday_interval, recurrence))
    day_from, day_to = (unpack_date(c).cast("string") for c in (start_date, end_date))
    at, until = (_clock(unpack_seconds(c)) for c in (start_time, end_time))

    def every(n: Column, unit: str) -> Column:
        return F.when(n == 1, F.lit(f"Every {unit}")).otherwise(
            F.concat(F.lit("Every "), n.cast("string"), F.lit(f" {unit}s")))

    when_text = (F.when(ft == FREQ_ONCE, F.concat(F.lit("Once on "), day_from, F.lit(":"), at))
                 .when(ft == FREQ_DAILY, every(fi, "day"))
                 .when(ft == FREQ_WEEKLY, every(rec, "week")))
    units = F.create_map(*[F.lit(x) for kv in SUBDAY_UNITS.items() for x in kv])
    often = F.concat(F.lit("Every "), si.cast("string"), F.lit(" "), F.try_element_at(units, st),
                     F.when(si > 1, "s").otherwise(""),
                     F.lit(" between "), at, F.lit(" and "), until)
    detail = (F.when(st == 0, "").when(st == 1, F.concat(F.lit("At "), at))
              .when(st.isin(list(SUBDAY_UNITS)), often))
    recurring = ft.isin(FREQ_DAILY, FREQ_WEEKLY, FREQ_MONTHLY, FREQ_MONTHLY_RELATIVE)
    active = (F.when(recurring & (as_col(end_date) == OPEN_END_DATE), F.concat(F.lit("Starting on "), day_from))
              .when(recurring, F.concat(F.lit("Between "), day_from, F.lit(" and "), day_to))
              .otherwise(""))
    days = F.when(ft == FREQ_WEEKLY, bitmask_labels(fi, WEEKDAY_BITS)).otherwise("X")
    return {"when_text": when_text, "detail_text": detail, "active_text": active, "day_text": days}
