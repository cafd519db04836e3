"""Dimensional model: K."""

from pyspark.sql import functions as F

from ...operators import model
from .. import flagship
from . import SNAPSHOTS, check, day
from .columns import key_sql


@check("k1_build_dimension", f"""WITH m AS (SELECT CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0
UNION SELECT CAST(s_nationkey AS VARCHAR), 'HOUSEHOLD' FROM supplier)
SELECT {key_sql("upper(nation || chr(31) || segment)")} AS member_key, nation, segment FROM m""")
def _(t):
    suppliers = t.supplier.withColumn("kind", F.lit("HOUSEHOLD"))
    return model.build_dimension([
        model.DimensionSource(t.customer, {"nation": "c_nationkey", "segment": "c_mktsegment"}, F.col("c_acctbal") > 0),
        model.DimensionSource(suppliers, {"nation": "s_nationkey", "segment": "kind"})], "member_key")


@check("k2_date_dimension", """WITH y AS (SELECT min(y) AS lo, max(y) AS hi FROM (SELECT year(min(o_orderdate)) AS y FROM orders UNION ALL SELECT year(max(l_shipdate)) FROM lineitem)),
d AS (SELECT CAST(unnest(generate_series(make_date(lo, 1, 1), make_date(hi, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM y)
SELECT strftime(d, '%Y-%m-%d') AS date, year(d) * 100 + month(d) AS year_month_key, isodow(d) AS day_of_week, 'Week ' || weekofyear(d) AS week_name, dayname(d) AS weekday_name,
left(monthname(d), 3) || '-' || year(d) AS month_year_label, date_diff('day', d, DATE '2002-01-01') AS day_index FROM d""")
def _(t):
    dim = model.date_dimension([(t.orders, "o_orderdate"), (t.lineitem, "l_shipdate")], F.lit("2002-01-01").cast("date"))
    return dim.select("date", "year_month_key", "day_of_week", "week_name", "weekday_name", "month_year_label", "day_index")


@check("k3_time_dimension", "SELECT s AS time_key, strftime(TIMESTAMP '2024-01-01' + INTERVAL (s) SECOND, '%H:%M:%S') AS time, s // 3600 AS hour, s // 60 % 60 AS minute, s % 60 AS second, coalesce(n, 0) AS events FROM range(86400) AS r(s) LEFT JOIN (SELECT hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS k, count(*) AS n FROM events GROUP BY 1) ON k = s")
def _(t):
    from ...functions.columns import time_key
    counts = t.events.groupBy(time_key("ts").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    dim = model.time_dimension(t.spark).join(counts, F.col("k") == F.col("time_key"), "left")
    return dim.withColumn("events", F.coalesce("n", F.lit(0))).drop("k", "n")


@check("k4_junk_dimension", "SELECT label, CAST(sort_order AS BIGINT) AS sort_order, count(*) AS n FROM orders JOIN (VALUES (1, 'Urgent', 1), (2, 'High', 2), (3, 'Medium', 3)) AS v(code, label, sort_order) ON code = CAST(left(o_orderpriority, 1) AS INTEGER) GROUP BY 1, 2")
def _(t):
    dim = model.dimension_rows(t.spark, {1: "Urgent", 2: "High", 3: "Medium"}, "code", "label")
    return t.orders.join(dim, F.left("o_orderpriority", F.lit(1)).cast("int") == F.col("code")).groupBy("label", "sort_order").agg(F.count(F.lit(1)).alias("n"))


@check("k5_attach_keys", f"""SELECT p_partkey, {key_sql("upper(p_brand)")} AS brand_key, {key_sql("upper(p_brand || chr(31) || coalesce(nullif(p_type, 'SMALL'), 'N.A.'))")} AS type_key FROM part""")
def _(t):
    p = t.part.select("p_partkey", "p_brand", F.nullif("p_type", F.lit("SMALL")).alias("p_type"))
    return model.attach_keys(p, [model.KeySpec("brand_key", ["p_brand"]), model.KeySpec("type_key", ["p_brand", "p_type"], {"p_type": "N.A."})]).drop("p_brand", "p_type")


@check("k6_star_join", """SELECT n_name AS nation_n_name, p_brand AS part_p_brand, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem
LEFT JOIN part ON p_partkey = l_partkey JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def _(t):
    star = model.star_join(t.lineitem, [
        model.Relation("part", t.part.select("p_partkey", "p_brand"), "l_partkey", "p_partkey"),
        model.Relation("supplier", t.supplier.filter("s_acctbal > 0").select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey", both_ways=True),
        model.Relation("nation", t.nation.select("n_nationkey", "n_name"), "supplier_s_nationkey", "n_nationkey"),
        model.Relation("order", t.orders, "l_orderkey", "o_orderkey", active=False)])
    return star.groupBy("nation_n_name", "part_p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@check("k6_star_join_inactive", "SELECT o_orderpriority AS order_o_orderpriority, count(*) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def _(t):
    rel = model.Relation("order", t.orders.select("o_orderkey", "o_orderpriority"), "l_orderkey", "o_orderkey", active=False)
    return model.star_join(t.lineitem.select("l_orderkey"), [rel], use_inactive=["order"]).groupBy("order_o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@check("k6_restrict_dimension", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' AND l_discount > 0.09)")
def _(t):
    fact = t.lineitem.filter("l_quantity > 49 AND l_returnflag = 'R' AND l_discount > 0.09")
    return model.restrict_dimension(t.supplier, "s_suppkey", fact, "l_suppkey").select("s_suppkey")


@check("flagship_daily_gains", f"""WITH {SNAPSHOTS},
p AS (SELECT *, lag(total) OVER w AS p_total, lag(hits) OVER w AS p_hits, lag(epoch) OVER w AS p_epoch, lag(ts) OVER w AS p_ts FROM snap WINDOW w AS (PARTITION BY entity ORDER BY ts)),
d AS (SELECT entity, ts, CASE WHEN date_diff('hour', p_ts, ts) > 12 OR p_total IS NULL THEN NULL WHEN p_total > total OR p_epoch <> epoch THEN total ELSE total - p_total END AS a,
CASE WHEN date_diff('hour', p_ts, ts) > 12 OR p_hits IS NULL THEN NULL WHEN p_hits > hits OR p_epoch <> epoch THEN hits ELSE hits - p_hits END AS b FROM p)
SELECT entity, {day('ts')} AS date, 'Week ' || weekofyear(ts) AS date_week_name, CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS date_is_weekend,
CAST(sum(a) AS BIGINT) AS total, CAST(sum(b) AS BIGINT) AS hits, CAST(sum(CASE WHEN hour(ts) BETWEEN 8 AND 17 THEN b END) AS BIGINT) AS office_hits FROM d WHERE a <> 0 OR b <> 0 GROUP BY 1, 2, 3, 4""")
def _(t):
    return flagship.gains_by_day(t.snapshots, t.spark)
