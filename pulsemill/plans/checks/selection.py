"""Filters and snapshot choice: C."""

from pyspark.sql import functions as F

from ...operators import select
from . import SNAPSHOTS, STATE, at, check, day

_LINE = "l_orderkey, l_linenumber, l_partkey"


@check("c1_latest_snapshot", f"SELECT {_LINE} , {day('l_shipdate')} AS ship_day FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)".replace("l_linenumber", "CAST(l_linenumber AS BIGINT) AS l_linenumber"))
def _(t):
    return select.latest_snapshot(t.lineitem, "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("ship_day"))


@check("c1_latest_snapshot_of_other_table", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate = (SELECT max(o_orderdate) FROM orders)")
def _(t):
    stamps = t.orders.select(F.col("o_orderdate").alias("l_shipdate"))
    return select.latest_snapshot(t.lineitem, "l_shipdate", stamps).select("l_orderkey", "l_partkey")


@check("c2_last_snapshot_per_day", f"""SELECT event_id, {at('h')} AS h FROM (SELECT event_id, date_trunc('hour', ts) AS h FROM events)
QUALIFY rank() OVER (PARTITION BY CAST(h AS DATE) ORDER BY h DESC) = 1""")
def _(t):
    return select.last_snapshot_per_day(t.events.select("event_id", F.date_trunc("hour", "ts").alias("h")), "h")


@check("c3_lookback_boundary", "SELECT event_id FROM events WHERE date_diff('day', ts, (SELECT max(ts) FROM events)) < 7")
def _(t):
    return select.lookback(t.events, "ts", 7, "day").select("event_id")


@check("c3_lookback_exact", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR")
def _(t):
    return select.lookback(t.events, "ts", 36, "hour", exact=True).select("event_id")


@check("c4_newest_n", f"SELECT event_id, {at('ts')} AS ts FROM events ORDER BY events.ts DESC, event_id LIMIT 25")
def _(t):
    return select.newest_n(t.events.select("event_id", "ts"), "ts", 25, ["event_id"])


@check("c5_current_rows", f"WITH {STATE} SELECT entity, key, value, {at('valid_from')} AS valid_from FROM state WHERE valid_to = TIMESTAMP '9999-12-31 23:59:59'")
def _(t):
    return select.current_rows(t.state).drop("valid_to")


@check("c6_any_nonzero", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount, l_tax FROM lineitem
WHERE nullif(l_discount, 0.05) <> 0 OR l_tax <> 0""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", F.nullif("l_discount", F.lit(0.05)).alias("d"))
    return select.any_nonzero(d, ["d", "l_tax"]).drop("d")


@check("c7_sentinels", "SELECT event_id, event_type FROM events WHERE event_type <> 'view' UNION ALL SELECT CAST(-1 AS BIGINT), 'nothing found'")
def _(t):
    e = t.events.select("event_id", "event_type")
    return select.add_sentinel(select.drop_sentinels(e, {"event_type": "view"}), {"event_id": -1, "event_type": "nothing found"})


@check("c8_top_n_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def _(t):
    return select.top_n_by(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 1000, ["o_orderkey"])


@check("c8_top_0_keeps_all", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return select.top_n_by(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 0)


@check("c9_name_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'signup') OR event_type LIKE '%rch%'")
def _(t):
    return t.events.filter(select.name_filter("event_type", ["CLICK", "signup"], ["%RCH%"])).select("event_id", "event_type")


_RANK = "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END"


@check("c10_best_mode_rows", f"""WITH x AS (SELECT l_suppkey, l_orderkey, l_returnflag, l_shipdate, {_RANK} AS r FROM lineitem
  WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 2400 HOUR)
SELECT l_suppkey, l_orderkey, l_returnflag, {day('l_shipdate')} AS d FROM x
QUALIFY dense_rank() OVER (PARTITION BY l_suppkey ORDER BY r, l_shipdate DESC) = 1""")
def _(t):
    return select.best_mode_rows(t.lineitem, "l_suppkey", "l_returnflag", ["R", "A", "N"], "l_shipdate", 2400).select(
        "l_suppkey", "l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("d"))


@check("c11_prefer_detail_per_day", f"""SELECT l_suppkey, l_orderkey, l_returnflag, {day('l_shipdate')} AS d FROM lineitem
QUALIFY dense_rank() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY {_RANK}) = 1""")
def _(t):
    return select.prefer_detail_per_day(t.lineitem, "l_suppkey", "l_returnflag", ["R", "A", "N"], "l_shipdate").select(
        "l_suppkey", "l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("d"))


_MODES = "CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'A' THEN 'A' END"
_MODE_RANK = f"CASE {_MODES} WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END"


def _some_modes_null(t):
    return t.lineitem.withColumn("l_returnflag", F.when(F.col("l_returnflag").isin("R", "A"), F.col("l_returnflag")))


@check("c10_best_mode_rows_null", f"""WITH x AS (SELECT l_suppkey, l_orderkey, {_MODES} AS mode, l_shipdate, {_MODE_RANK} AS r FROM lineitem
  WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 24000 HOUR)
SELECT l_suppkey, l_orderkey, mode, {day('l_shipdate')} AS d FROM x
QUALIFY dense_rank() OVER (PARTITION BY l_suppkey ORDER BY r, l_shipdate DESC) = 1""")
def _(t):
    return select.best_mode_rows(_some_modes_null(t), "l_suppkey", "l_returnflag", ["R", "A", "N"], "l_shipdate", 24000).select(
        "l_suppkey", "l_orderkey", F.col("l_returnflag").alias("mode"), F.to_date("l_shipdate").alias("d"))


@check("c11_prefer_detail_per_day_null", f"""SELECT l_suppkey, l_orderkey, {_MODES} AS mode, {day('l_shipdate')} AS d FROM lineitem
QUALIFY dense_rank() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY {_MODE_RANK}) = 1""")
def _(t):
    return select.prefer_detail_per_day(_some_modes_null(t), "l_suppkey", "l_returnflag", ["R", "A", "N"], "l_shipdate").select(
        "l_suppkey", "l_orderkey", F.col("l_returnflag").alias("mode"), F.to_date("l_shipdate").alias("d"))


@check("c1_latest_counters", f"WITH {SNAPSHOTS} SELECT entity, total, hits FROM snap WHERE ts = (SELECT max(ts) FROM snap)")
def _(t):
    return select.latest_snapshot(t.snapshots, "ts").select("entity", "total", "hits")
