"""Column functions: keys, dates, codes, units (inventory B and N).

Everything here returns a Column built from Spark's own functions, so it
stays inside whole-stage code generation; nothing is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ColumnLike = Column | str

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- dates and keys ---------------------------------------------------------

def time_key(ts: ColumnLike) -> Column:
    """Second of the day."""
    ts = as_col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def date_time_key(df: DataFrame, ts: str, date: str = "date", key: str = "time_key") -> DataFrame:
    """B1: add the calendar date and the second of the day of ``ts``."""
    return df.withColumns({date: F.to_date(ts), key: time_key(ts)})


def hash_key(*cols: ColumnLike, compat: bool = False) -> Column:
    """B2: one to six columns to a signed 64-bit key.

    Text is upper-cased (keys compare case-insensitively), nulls are skipped,
    and the low eight bytes of SHA-256 become a BIGINT.  ``compat=True``
    concatenates without a separator, so ('ab','c') equals ('a','bc').
    """
    if not 1 <= len(cols) <= 6:
        raise ValueError("hash_key takes one to six columns")
    sep = "" if compat else "\x1f"
    text = F.concat_ws(sep, *[F.upper(as_col(c).cast("string")) for c in cols])
    return F.conv(F.right(F.sha2(text, 256), F.lit(16)), 16, -10).cast("bigint")


def same_text(a: ColumnLike, b: ColumnLike) -> Column:
    """Case-insensitive, null-safe equality of two texts."""
    return F.upper(as_col(a)).eqNullSafe(F.upper(as_col(b)))


# -- codes and labels -------------------------------------------------------

def decode(col: ColumnLike, mapping: Mapping, unknown: str = "?:") -> Column:
    """Code to label; a code outside ``mapping`` stays visible as '?:code'."""
    col = as_col(col)
    entries = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], mapping.items(), [])
    label = F.try_element_at(F.create_map(*entries), col)
    return F.when(col.isNotNull(), F.coalesce(label, F.concat(F.lit(unknown), col.cast("string"))))


def yes_no(col: ColumnLike, null: str = "N.A.") -> Column:
    """B5"""
    flag = as_col(col).cast("boolean")
    return F.when(flag, "Yes").when(~flag, "No").otherwise(null)


def display_text(col: ColumnLike) -> Column:
    """B6: 'SOME_STATE' to 'Some state'."""
    plain = F.lower(F.replace(as_col(col), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substr(plain, F.lit(2)))


def truncate_text(col: ColumnLike, n: int, marker: str = "\n...Statement truncated") -> Column:
    """B7"""
    col = as_col(col)
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(n)), F.lit(marker))).otherwise(col)


def strip_leading_lf(col: ColumnLike) -> Column:
    """Drop one leading line feed."""
    return F.regexp_replace(as_col(col), r"\A\n", "")


# -- packed dates and times -------------------------------------------------

def unpack_date(packed: ColumnLike) -> Column:
    """yyyymmdd integer to DATE; null when it names no calendar day."""
    return F.try_to_date(F.lpad(as_col(packed).cast("string"), 8, "0"), "yyyyMMdd")


def unpack_seconds(packed: ColumnLike) -> Column:
    """Hhmmss integer to seconds; the hour part may pass 24."""
    p = as_col(packed).cast("bigint")
    return F.floor(p / 10000) * 3600 + F.floor(p / 100) % 100 * 60 + p % 100


packed_duration = unpack_seconds


def packed_datetime(date_int: ColumnLike, time_int: ColumnLike) -> Column:
    """(yyyymmdd, hhmmss) to TIMESTAMP."""
    midnight = F.unix_timestamp(unpack_date(date_int).cast("timestamp"))
    return F.timestamp_seconds(midnight + unpack_seconds(time_int))


def pack_date(ts: ColumnLike) -> Column:
    ts = as_col(ts)
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)


def pack_time(ts: ColumnLike) -> Column:
    ts = as_col(ts)
    return F.hour(ts) * 10000 + F.minute(ts) * 100 + F.second(ts)


def pack_duration(seconds: ColumnLike) -> Column:
    s = as_col(seconds).cast("bigint")
    return F.floor(s / 3600) * 10000 + F.floor(s / 60) % 60 * 100 + s % 60


# -- arithmetic -------------------------------------------------------------

def at_least_one(seconds: ColumnLike) -> Column:
    """A run of 0 s counts as 1 s; null counts as 1 too."""
    seconds = as_col(seconds)
    return F.coalesce(F.nullif(seconds, F.lit(0)), F.lit(1))


def pages_to_kb(pages: ColumnLike) -> Column:
    """B11"""
    return as_col(pages) * 8


def pages_to_mb(pages: ColumnLike) -> Column:
    return as_col(pages) / 128.0


def kb_to_mb(kb: ColumnLike) -> Column:
    return as_col(kb) / 1024.0


def bytes_to_mb(n: ColumnLike) -> Column:
    return as_col(n) / 1048576.0


def us_to_ms(us: ColumnLike) -> Column:
    """Whole milliseconds; the fraction is cut."""
    return F.floor(as_col(us) / 1000)


def datediff_boundary(unit: str, a: ColumnLike, b: ColumnLike) -> Column:
    """Number of ``unit`` boundaries crossed going from ``a`` to ``b``.

    00:59 to 02:01 is two hours here, where elapsed whole hours would be one.
    """
    a, b = as_col(a), as_col(b)
    if unit in _UNIT_SECONDS:
        size = _UNIT_SECONDS[unit]
        return (F.floor(F.unix_seconds(b.cast("timestamp")) / size)
                - F.floor(F.unix_seconds(a.cast("timestamp")) / size))
    if unit == "millisecond":
        return F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp"))
    if unit == "day":
        return F.date_diff(F.to_date(b), F.to_date(a)).cast("bigint")
    if unit == "month":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    raise ValueError(f"unknown unit {unit!r}")


def age(unit: str, ts: ColumnLike, now: ColumnLike) -> Column:
    """Age of ``ts`` in crossed boundaries; the present is always stated."""
    return datediff_boundary(unit, ts, now)


def safe_ratio(num: ColumnLike, den: ColumnLike, scale: int | None = None,
               lift_zero: bool = False) -> Column:
    """Num / den, null when den is 0; ``lift_zero`` reads a 0 numerator as 1."""
    num, den = as_col(num), as_col(den)
    if lift_zero:
        num = F.when(num == 0, F.lit(1)).otherwise(num)
    ratio = F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))
    return ratio if scale is None else F.round(ratio, scale)


def other_share(*shares: ColumnLike, whole: int = 100) -> Column:
    """What the given shares leave of the whole."""
    return reduce(lambda rest, s: rest - as_col(s), shares, F.lit(whole))


# -- text parts -------------------------------------------------------------

def slice_text(col: ColumnLike, start: ColumnLike, end: ColumnLike) -> Column:
    """The statement between two byte offsets of two-byte characters.

    The end offset counts to the start of the last character; -1 means the
    end of the text.
    """
    col, start, end = as_col(col), as_col(start), as_col(end)
    first = F.floor(start / 2) + 1
    stop = F.when(end == -1, F.length(col)).otherwise(F.floor(end / 2) + 1)
    return F.substring(col, first.cast("int"), F.greatest(stop - first + 1, F.lit(0)).cast("int"))


def parse_kv(col: ColumnLike, pairs: str = ";", assign: str = "=", quote: str = "'") -> Column:
    """B17: '@a = 1; b = ''x''' to a map with trimmed names and unquoted values.

    ``pairs``, ``assign`` and ``quote`` are single characters.  Parts without
    the assign character are skipped; a name given twice keeps its last value.
    """
    parts = F.filter(F.split(as_col(col), f"[{pairs}]"), lambda p: F.contains(p, F.lit(assign)))
    cut = lambda p: F.instr(p, assign)
    name = lambda p: F.trim(F.substr(p, F.lit(1), cut(p) - 1))
    value = lambda p: F.trim(F.trim(F.substr(p, cut(p) + 1)), F.lit(quote))
    entries = F.transform(parts, lambda p: F.struct(name(p).alias("k"), value(p).alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(names, F.transform(names, last))


def safe_int(col: ColumnLike) -> Column:
    """Digits only, else null (also when the number is too large)."""
    col = F.trim(as_col(col))
    return F.when(col.rlike("^[0-9]+$"), col.try_cast("bigint"))


def bitmask_labels(mask: ColumnLike, labels: Mapping[int, str], sep: str = "\n") -> Column:
    """Labels of the bits set in ``mask``, in the order of ``labels``."""
    mask = as_col(mask)
    present = [F.when(mask.bitwiseAND(F.lit(bit)) == bit, F.lit(text)) for bit, text in labels.items()]
    return F.concat_ws(sep, *present)


def split_category(col: ColumnLike) -> dict[str, Column]:
    """B22: 'db:file:page' cut at the first and the last ':'."""
    col = as_col(col)
    return {"head": F.substring_index(col, ":", 1),
            "middle": F.regexp_extract(col, "^[^:]*:(.*):[^:]*$", 1),
            "tail": F.substring_index(col, ":", -1)}


def quote_path(*parts: ColumnLike) -> Column:
    """[schema].[name], with ']' doubled inside a part."""
    quoted = [F.concat(F.lit("["), F.replace(as_col(p), F.lit("]"), F.lit("]]")), F.lit("]"))
              for p in parts]
    return F.concat_ws(".", *quoted)


def range_text(name: ColumnLike, value: ColumnLike, before: ColumnLike, after: ColumnLike,
               right: ColumnLike, infinity: str = "Infinity") -> Column:
    """The values one partition covers, in words.

    ``before`` and ``after`` are the neighbours' boundary values; ``right``
    tells whether a boundary belongs to the partition on its right.
    """
    name = as_col(name)
    text = lambda c: F.coalesce(as_col(c).cast("string"), F.lit(infinity))
    left_range = F.concat(name, F.lit(" > "), text(before), F.lit(" and "), name, F.lit(" <= "), text(value))
    right_range = F.concat(name, F.lit(" >= "), text(value), F.lit(" and "), name, F.lit(" < "), text(after))
    return F.when(as_col(right).cast("boolean"), right_range).otherwise(left_range)


def hex_key(binary: ColumnLike) -> Column:
    """B25"""
    return F.concat(F.lit("0x"), F.hex(as_col(binary)))


# Command kinds of a maintenance log, with their report codes.
COMMAND_KINDS = (
    ("ALTER_INDEX", "% REBUILD %", 1),
    ("ALTER_INDEX", "% REORGANIZE %", 2),
    ("UPDATE_STATISTICS", None, 3),
    ("BACKUP_DATABASE", None, 4),
    ("BACKUP_LOG", None, 5),
    ("RESTORE_VERIFYONLY", None, 6),
    ("DBCC_CHECKDB", None, 7),
    ("xp_create_subdir", None, 8),
    ("xp_delete_file", None, 9),
)


def classify_command(kind: ColumnLike, text: ColumnLike, rules: Sequence = COMMAND_KINDS) -> Column:
    """First rule (kind, LIKE pattern or None, code) that fits, else null."""
    kind, text = as_col(kind), as_col(text)
    tests = [((F.upper(kind) == k.upper()) & (F.upper(text).like(p.upper()) if p else F.lit(True)), code)
             for k, p, code in rules]
    return F.coalesce(*[F.when(test, F.lit(code)) for test, code in tests])


# -- calendar ---------------------------------------------------------------

def calendar_columns(day: ColumnLike, today: ColumnLike) -> dict[str, Column]:
    """Attributes of a date; ``today`` is stated, never read from a clock."""
    day, today = as_col(day), as_col(today)
    week = F.weekofyear(day)
    return {
        "year_month_key": F.year(day) * 100 + F.month(day),
        "day_of_week": F.weekday(day) + 1,
        "day_of_month": F.dayofmonth(day),
        "day_of_year": F.dayofyear(day),
        "week_number": week,
        "week_name": F.concat(F.lit("Week "), week.cast("string")),
        "is_weekend": F.when(F.weekday(day) >= 5, 1).otherwise(0),
        "weekday_name": F.date_format(day, "EEEE"),
        "weekday_abbreviation": F.date_format(day, "EEE"),
        "month_number": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "month_abbreviation": F.date_format(day, "MMM"),
        "quarter_number": F.quarter(day),
        "quarter_label": F.concat(F.lit("Q"), F.quarter(day).cast("string")),
        "year": F.year(day),
        "month_year_label": F.date_format(day, "MMM-yyyy"),
        "day_index": F.date_diff(today, day),
    }


def support_state(mainstream_end: ColumnLike, extended_end: ColumnLike, today: ColumnLike) -> Column:
    """B28"""
    mainstream_end, extended_end, today = map(as_col, (mainstream_end, extended_end, today))
    return (F.when(today <= mainstream_end, "In support")
            .when(today <= extended_end, "Extended support")
            .when(F.coalesce(extended_end, mainstream_end).isNotNull(), "Unsupported"))
