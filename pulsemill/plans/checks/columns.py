"""Column functions: B and N."""

from pyspark.sql import functions as F

from ...functions import columns as c, text as x
from ...operators import chunked, runs
from . import SCHEDULES, at, check, day

def key_sql(expr: str) -> str:
    """SQL twin of hash_key over a joined, upper-cased text."""
    low = f"CAST('0x' || right(sha256({expr}), 16) AS UBIGINT)"
    return f"CAST(CASE WHEN {low} >= 9223372036854775808 THEN CAST({low} AS HUGEINT) - 18446744073709551616 ELSE {low} END AS BIGINT)"


@check("b1_date_time_key", f"SELECT event_id, {day('ts')} AS date, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS time_key FROM events")
def _(t):
    return c.date_time_key(t.events, "ts").select("event_id", "date", "time_key")


@check("b2_hash_key", f"""SELECT p_partkey, {key_sql("upper(p_brand) || chr(31) || upper(p_type)")} AS key2, {key_sql("upper(p_brand) || upper(p_type)")} AS compat2,
{key_sql("upper(concat_ws(chr(31), p_brand, nullif(p_type, 'SMALL'), p_size))")} AS key3 FROM part""")
def _(t):
    return t.part.select("p_partkey", c.hash_key("p_brand", "p_type").alias("key2"), c.hash_key("p_brand", "p_type", compat=True).alias("compat2"),
                         c.hash_key("p_brand", F.nullif("p_type", F.lit("SMALL")), "p_size").alias("key3"))


@check("b3_same_text", "SELECT event_id FROM events WHERE upper(event_type) = 'VIEW'")
def _(t):
    return t.events.filter(c.same_text("event_type", F.lit("View"))).select("event_id")


@check("b4_b5_b6_labels", """SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE '?:' || event_type END AS label,
CASE WHEN event_type = 'error' THEN 'N.A.' WHEN value > 50 THEN 'Yes' ELSE 'No' END AS flag,
upper(left(event_type, 1)) || substr(event_type, 2) || ' state ' || user_id AS shown FROM events""")
def _(t):
    kind = F.col("event_type")
    return t.events.select("event_id", c.decode("event_type", {"click": "Click", "view": "View"}).alias("label"),
                           c.yes_no(F.when(kind != "error", F.col("value") > 50)).alias("flag"),
                           c.display_text(F.upper(F.concat(kind, F.lit("_STATE_"), F.col("user_id").cast("string")))).alias("shown"))


@check("b7_truncate_text", "SELECT doc_id, length(text) AS full_length, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || chr(10) || '...Statement truncated' ELSE text END) AS shown FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("full_length"), F.md5(c.truncate_text("text", 200)).alias("shown"))


@check("b8_strip_leading_lf", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE chr(10) || text END) AS one_stripped FROM documents")
def _(t):
    lf = F.lit("\n")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(lf, "text")).otherwise(F.concat(lf, lf, "text"))
    return t.documents.select("doc_id", F.md5(c.strip_leading_lf(text)).alias("one_stripped"))


@check("b9_packed_datetime", f"SELECT event_id, {at('ts')} AS unpacked, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS packed_date, CAST(strftime(ts, '%H%M%S') AS BIGINT) AS packed_time, event_id AS seconds, (event_id // 3600) * 10000 + (event_id // 60 % 60) * 100 + event_id % 60 AS packed_duration FROM events")
def _(t):
    e = t.events.withColumns({"packed_date": c.pack_date("ts"), "packed_time": c.pack_time("ts"), "packed_duration": c.pack_duration("event_id")})
    return e.select("event_id", c.packed_datetime("packed_date", "packed_time").alias("unpacked"), "packed_date", "packed_time",
                    c.packed_duration("packed_duration").alias("seconds"), "packed_duration")


@check("b10_b11_b14_units", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(nullif(l_partkey % 4, 0), 1) AS secs, l_partkey * 8 AS kb, l_partkey / 128.0 AS mb,
l_suppkey / 1024.0 AS kb_mb, l_orderkey / 1048576.0 AS b_mb, l_partkey // 1000 AS ms, 100 - l_partkey % 30 - l_suppkey % 20 AS rest FROM lineitem""")
def _(t):
    rest = c.other_share(F.col("l_partkey") % 30, F.col("l_suppkey") % 20)
    return t.lineitem.select("l_orderkey", "l_linenumber", c.at_least_one(F.col("l_partkey") % 4).alias("secs"), c.pages_to_kb("l_partkey").alias("kb"),
                             (F.col("l_partkey") / F.lit(128.0)).alias("mb"), (F.col("l_suppkey") / F.lit(1024.0)).alias("kb_mb"),
                             (F.col("l_orderkey") / F.lit(1048576.0)).alias("b_mb"), c.us_to_ms("l_partkey").alias("ms"), rest.alias("rest"))


_UNITS = ("millisecond", "second", "minute", "hour", "day", "month", "year")


@check("b12_datediff_boundary", "SELECT event_id, " + ", ".join(f"date_diff('{u}', TIMESTAMP '2023-12-31 23:30:30.5', ts) AS d_{u}" for u in _UNITS) + " FROM events")
def _(t):
    start = F.lit("2023-12-31 23:30:30.5").cast("timestamp")
    return t.events.select("event_id", *[c.datediff_boundary(u, start, "ts").alias(f"d_{u}") for u in _UNITS])


@check("b13_safe_ratio", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity / nullif(CAST(l_partkey % 5 AS DOUBLE), 0) AS plain_ratio,
(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_partkey % 3 END) / nullif(CAST(l_suppkey % 2 AS DOUBLE), 0) AS lifted FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", c.safe_ratio("l_quantity", F.col("l_partkey") % 5).alias("plain_ratio"),
                             c.safe_ratio(F.col("l_partkey") % 3, F.col("l_suppkey") % 2, lift_zero=True).alias("lifted"))


@check("b15_slice_text", """SELECT doc_id, md5(substr(text, doc_id % 50 + 1, CASE WHEN doc_id % 3 = 0 THEN length(text) ELSE 41 END)) AS slice FROM documents""")
def _(t):
    start = F.col("doc_id") % 50 * 2
    end = F.when(F.col("doc_id") % 3 == 0, -1).otherwise(start + 80)
    return t.documents.select("doc_id", F.md5(c.slice_text("text", start, end)).alias("slice"))


@check("b16_split_part_table", "SELECT p_partkey, i AS part_no, trim(string_split(p_name, ' ')[i]) AS part FROM part, LATERAL (SELECT unnest(generate_series(1, len(string_split(p_name, ' ')))) AS i)")
def _(t):
    return x.split_part_table(t.part.select("p_partkey", "p_name"), "p_name", " ").drop("p_name")


@check("b17_parse_kv", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who, NULL AS missing FROM events".replace("NULL", "CAST(NULL AS VARCHAR)"))
def _(t):
    text = F.concat(F.lit(" @Kind = '"), "event_type", F.lit("' ;no value; @Who="), F.col("user_id").cast("string"), F.lit(" ;"))
    kv = c.parse_kv(text)
    get = lambda k: F.try_element_at(kv, F.lit(k))
    return t.events.select("event_id", get("@Kind").alias("kind"), get("@Who").alias("who"), get("@Other").alias("missing"))


@check("b18_safe_int", """SELECT event_id, CASE WHEN event_type = 'click' THEN user_id END AS n FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "click", F.col("user_id").cast("string")).otherwise(F.concat("event_type", F.col("user_id").cast("string")))
    return t.events.select("event_id", c.safe_int(text).alias("n"))


@check("b19_select_by_patterns", """SELECT p_partkey, CAST(CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 WHEN p_brand = 'Brand#22' THEN 3 ELSE 4 END AS BIGINT) AS match_position FROM part
WHERE (p_brand LIKE 'Brand#1%' OR p_brand = 'Brand#22' OR p_size > 40) AND p_brand <> 'Brand#12'""")
def _(t):
    return x.select_by_patterns(t.part, "p_brand", "brand#1%, -BRAND#12,[Brand#22], LARGE_ONES", {"large_ones": F.col("p_size") > 40}).select(
        "p_partkey", "match_position")


@check("b19_pattern_table", """WITH list AS (SELECT c_custkey AS position, c_custkey % 5 = 2 AS gone, CASE c_custkey % 5 WHEN 0 THEN 'Customer#%' || right(c_name, 3)
WHEN 1 THEN '%' || right(c_name, 3) || '%' || right(c_name, 1) WHEN 4 THEN left(c_name, 17) || '%' ELSE c_name END AS pattern FROM customer WHERE c_nationkey < 5),
met AS (SELECT c_custkey, min(CASE WHEN NOT gone THEN position END) AS match_position, bool_or(gone) AS gone FROM customer JOIN list ON c_name LIKE pattern GROUP BY c_custkey)
SELECT c_custkey, match_position FROM met WHERE match_position IS NOT NULL AND NOT gone""")
def _(t):
    name, last = F.col("c_name"), lambda n: F.right("c_name", F.lit(n))
    kind = F.col("c_custkey") % 5
    item = (F.when(kind == 0, F.concat(F.lit("customer#%"), last(3))).when(kind == 1, F.concat(F.lit("%"), last(3), F.lit("%"), last(1)))
            .when(kind == 2, F.concat(F.lit("-"), name)).when(kind == 3, F.concat(F.lit(" ["), F.lower(name), F.lit("]")))
            .otherwise(F.concat(F.left(name, F.lit(17)), F.lit("%"))))
    listed = t.customer.filter("c_nationkey < 5").select(item.alias("pattern"), F.col("c_custkey").alias("position"))
    return x.select_by_pattern_table(t.customer, "c_name", listed).select("c_custkey", "match_position")


_BITS = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {{0}} & {b} = {b} THEN '{n}' END" for b, n in x.WEEKDAY_BITS.items()) + ")"


@check("b20_bitmask_labels", f"SELECT event_id, {_BITS.format('(event_id % 128)')} AS days FROM events")
def _(t):
    return t.events.select("event_id", c.bitmask_labels(F.col("event_id") % 128, x.WEEKDAY_BITS).alias("days"))


SCHEDULE_TEXT = f"""
CASE freq_type WHEN 1 THEN 'Once on ' || start_date || ':' || t0 WHEN 4 THEN CASE WHEN freq_interval = 1 THEN 'Every day' ELSE 'Every ' || freq_interval || ' days' END
  ELSE CASE WHEN recurrence = 1 THEN 'Every week' ELSE 'Every ' || recurrence || ' weeks' END END AS when_text,
CASE subday_type WHEN 1 THEN 'At ' || t0 ELSE 'Every ' || subday_interval || CASE subday_type WHEN 2 THEN ' second' WHEN 4 THEN ' minute' ELSE ' hour' END
  || CASE WHEN subday_interval > 1 THEN 's' ELSE '' END || ' between ' || t0 || ' and ' || t1 END AS detail_text,
CASE WHEN freq_type = 1 THEN '' WHEN end_date = DATE '9999-12-31' THEN 'Starting on ' || start_date ELSE 'Between ' || start_date || ' and ' || end_date END AS active_text,
CASE WHEN freq_type = 8 THEN {_BITS.format('freq_interval')} ELSE 'X' END AS day_text"""


@check("b21_schedule_text", f"WITH {SCHEDULES} SELECT job, {SCHEDULE_TEXT} FROM sched")
def _(t):
    return t.schedules.select("job", *[col.alias(n) for n, col in x.schedule_text().items()])


@check("b22_b23_parts_of_names", """SELECT event_id, CAST(user_id AS VARCHAR) AS head, event_type AS middle, CAST(event_id AS VARCHAR) AS tail,
'[' || event_type || ']]x].[' || user_id || ']' AS path FROM events""")
def _(t):
    s = lambda n: F.col(n).cast("string")
    parts = c.split_category(F.concat_ws(":", s("user_id"), "event_type", s("event_id")))
    return t.events.select("event_id", *[col.alias(n) for n, col in parts.items()],
                           c.quote_path(F.concat("event_type", F.lit("]x")), s("user_id")).alias("path"))


@check("b24_range_text", """WITH b AS (SELECT DISTINCT p_brand, p_size FROM part),
n AS (SELECT *, lag(p_size) OVER w AS lo, lead(p_size) OVER w AS hi FROM b WINDOW w AS (PARTITION BY p_brand ORDER BY p_size))
SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, CASE WHEN length(p_brand) = 7 THEN 'size >= ' || p_size || ' and size < ' || coalesce(CAST(hi AS VARCHAR), 'Infinity')
ELSE 'size > ' || coalesce(CAST(lo AS VARCHAR), 'Infinity') || ' and size <= ' || p_size END AS covers FROM n""")
def _(t):
    b = t.part.select("p_brand", "p_size").distinct()
    by = chunked.by_range("p_size", 10)
    n = chunked.with_next(chunked.with_previous(b, "p_brand", "p_size", {"lo": "p_size"}, by), "p_brand", "p_size", {"hi": "p_size"}, by)
    return n.select("p_brand", "p_size", c.range_text(F.lit("size"), "p_size", "lo", "hi", F.length("p_brand") == 7).alias("covers"))


@check("b25_hex_key", "SELECT p_partkey, '0x' || hex(p_name) AS k FROM part")
def _(t):
    return t.part.select("p_partkey", c.hex_key(F.col("p_name").cast("binary")).alias("k"))


@check("b26_classify_command", """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END WHEN 'view' THEN 3 WHEN 'error' THEN 7 WHEN 'purchase' THEN 4 END AS BIGINT) AS kind,
greatest(CAST(floor(value) AS BIGINT), 1) AS duration_s FROM events""")
def _(t):
    e = t.events
    kind = F.col("event_type")
    command = (F.when(kind == "click", "ALTER_INDEX").when(kind == "view", "UPDATE_STATISTICS").when(kind == "error", "DBCC_CHECKDB")
               .when(kind == "purchase", "BACKUP_DATABASE").otherwise("OTHER"))
    body = F.concat(F.lit("ALTER INDEX i ON t "), F.when(F.col("user_id") % 2 == 0, "REBUILD").otherwise("REORGANIZE"), F.lit(" WITH (x)"))
    return e.select("event_id", c.classify_command(command, body).alias("kind"), c.at_least_one(F.floor("value")).alias("duration_s"))


@check("b27_calendar_columns", f"""SELECT DISTINCT {day('o_orderdate')} AS date, year(o_orderdate) * 100 + month(o_orderdate) AS year_month_key, isodow(o_orderdate) AS day_of_week, day(o_orderdate) AS day_of_month,
dayofyear(o_orderdate) AS day_of_year, weekofyear(o_orderdate) AS week_number, 'Week ' || weekofyear(o_orderdate) AS week_name, CAST(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
dayname(o_orderdate) AS weekday_name, left(dayname(o_orderdate), 3) AS weekday_abbreviation, month(o_orderdate) AS month_number, monthname(o_orderdate) AS month_name, left(monthname(o_orderdate), 3) AS month_abbreviation,
quarter(o_orderdate) AS quarter_number, 'Q' || quarter(o_orderdate) AS quarter_label, year(o_orderdate) AS year, left(monthname(o_orderdate), 3) || '-' || year(o_orderdate) AS month_year_label,
date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS day_index FROM orders""")
def _(t):
    d = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.select("date", *[col.alias(n) for n, col in c.calendar_columns("date", F.lit("2001-12-31").cast("date")).items()])


@check("b28_support_state", """SELECT o_orderkey, CASE WHEN DATE '2001-06-01' <= d + 365 THEN 'In support' WHEN DATE '2001-06-01' <= d + 1000 THEN 'Extended support' ELSE 'Unsupported' END AS state
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", c.support_state(F.date_add(d, 365), F.date_add(d, 1000), F.lit("2001-06-01").cast("date")).alias("state"))


@check("j2_run_status_text", """SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'Ended with errors' WHEN user_id % 2 = 0 THEN 'Succeeded' ELSE 'Failed' END AS status FROM events""")
def _(t):
    job = F.when(F.col("user_id") % 2 == 0, 1).otherwise(0)
    return t.events.select("event_id", runs.run_status_text(job, (F.col("event_id") % 3).cast("int")).alias("status"))
