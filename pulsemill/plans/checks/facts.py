"""Measures: L."""

from pyspark.sql import Column, DataFrame, functions as F

from ...operators import measures as m
from . import SNAPSHOTS, check, day

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _fact(t) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("date"),
                             F.col("l_quantity").cast("bigint").alias("quantity"), cents.alias("cents"))


@check("l1_l2_additive", f"""SELECT l_suppkey, CAST(sum({_CENTS}) AS BIGINT) AS cents, CAST(sum({_CENTS}) AS BIGINT) / 100.0 AS money, count(*) AS n, avg(CAST(l_quantity AS BIGINT)) AS mean_quantity,
{day('min(l_shipdate)')} AS first_day FROM lineitem GROUP BY 1""".replace("/ 100.0", "/ CAST(100 AS DOUBLE)"))
def _(t):
    return m.measure(_fact(t), "l_suppkey", cents=F.sum("cents"), money=F.sum("cents") / F.lit(100.0), n=F.count(F.lit(1)),
                     mean_quantity=F.avg("quantity"), first_day=F.min("date"))


@check("l3_ratio", f"SELECT l_partkey, CAST(sum({_CENTS}) AS DOUBLE) / nullif(CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE), 0) AS per_return FROM lineitem GROUP BY 1")
def _(t):
    returned = m.filtered_sum(F.col("l_returnflag") == "R", F.col("quantity"))
    return m.measure(_fact(t), "l_partkey", per_return=m.ratio_of(F.sum("cents"), returned))


@check("l4_share_over", """WITH s AS (SELECT l_suppkey, l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, CAST(v AS BIGINT) AS value, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS share FROM s""")
def _(t):
    return m.share_over(_fact(t), ["l_suppkey", "l_returnflag"], "l_suppkey", "quantity")


@check("l4_share_of_all", """WITH s AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(v AS BIGINT) AS value, CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) AS share FROM s""")
def _(t):
    return m.share_over(_fact(t), "l_suppkey", "l_suppkey", "quantity")


_DAYS = "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)"
_LATEST = "(SELECT max(d) FROM days WHERE d < (SELECT max(d) FROM days))"
_PAST = f"(SELECT min(d) FROM days WHERE d >= {_LATEST} - 30 AND d >= (SELECT min(d) + 1 FROM days))"


def _latest(f: DataFrame) -> Column:
    return m.latest_date(f, "date")


@check("l5_latest_date_trimmed", f"WITH {_DAYS} SELECT l_returnflag, {day(_LATEST)} AS latest, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) = {_LATEST} GROUP BY 1")
def _(t):
    f = _fact(t)
    latest = _latest(f)
    return f.filter(F.col("date") == latest).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).withColumn("latest", latest)


@check("l5_latest_date_chosen", f"WITH {_DAYS} SELECT {day('(SELECT max(d) FROM days)')} AS latest, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) = (SELECT max(d) FROM days)")
def _(t):
    f = _fact(t)
    last = f.select(F.max("date")).scalar()
    latest = m.latest_date(f, "date", chosen=(None, last))
    return f.filter(F.col("date") == latest).agg(F.count(F.lit(1)).alias("n")).withColumn("latest", latest)


@check("l6_past_date", f"WITH {_DAYS} SELECT {day(_PAST)} AS past, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) = {_PAST}")
def _(t):
    f = _fact(t)
    past = m.past_date(f, "date", _latest(f), 30)
    return f.filter(F.col("date") == past).agg(F.count(F.lit(1)).alias("n")).withColumn("past", past)


@check("l7_period_ratio", f"""WITH {_DAYS}, x AS (SELECT l_returnflag, l_linestatus, sum(CASE WHEN CAST(l_shipdate AS DATE) = {_LATEST} THEN CAST(l_quantity AS BIGINT) END) AS cur,
sum(CASE WHEN CAST(l_shipdate AS DATE) = {_PAST} THEN CAST(l_quantity AS BIGINT) END) AS past FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT {_LATEST} UNION SELECT {_PAST}) GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, CAST(cur AS BIGINT) AS current_value, CAST(past AS BIGINT) AS past_value, CAST(cur - past AS DOUBLE) / nullif(CAST(past AS DOUBLE), 0) AS ratio FROM x""")
def _(t):
    f = _fact(t)
    return m.period_ratio(f, ["l_returnflag", "l_linestatus"], "date", F.col("quantity"), m.period_days(f, "date", 30))


@check("l8_semi_additive", """WITH s AS (SELECT l_returnflag, l_shipdate, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, CAST(max(v) AS BIGINT) AS peak FROM s GROUP BY 1""")
def _(t):
    return m.semi_additive(_fact(t), "l_returnflag", "date", "quantity", F.max, "peak")


@check("l9_at_last_stamp", f"WITH {SNAPSHOTS} SELECT entity % 5 AS grp, CAST(sum(total) AS BIGINT) AS value FROM snap WHERE ts = (SELECT max(ts) FROM snap) AND entity > 3 GROUP BY 1")
def _(t):
    s = t.snapshots
    return m.at_last_stamp(s.filter("entity > 3").withColumn("grp", F.col("entity") % 5), "grp", "ts", "total", all_rows=s)


@check("l10_distinct_sets", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def _(t):
    from ...operators.aggregate import distinct_count
    return distinct_count(t.lineitem, "l_orderkey", "orders", "l_returnflag")


@check("l11_success_rate", """WITH x AS (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup', 'error')) AS total, count(*) FILTER (event_type IN ('purchase', 'signup')) AS good FROM events GROUP BY 1)
SELECT user_id, CAST(good AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0) AS success_rate FROM x""")
def _(t):
    return m.success_rate(t.events, "user_id", "event_type", ["purchase", "signup"], ["purchase", "signup", "error"])


@check("l12_filtered_sum", "SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS returned FROM lineitem GROUP BY 1")
def _(t):
    return m.measure(_fact(t), "l_suppkey", returned=m.filtered_sum(F.col("l_returnflag") == "R", F.col("quantity")))
