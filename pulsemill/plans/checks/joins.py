"""Joins, aggregations and reshaping: D, E, G."""

from pyspark.sql import functions as F

from ...operators import aggregate, joins, reshape
from . import HISTORY, STATE, at, check, day

_FLAGGED = "SELECT *, nullif(event_type, 'view') AS kind FROM events"


@check("d1_inner_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


def _per_kind(t):
    e = t.events.withColumn("kind", F.nullif("event_type", F.lit("view")))
    counts = e.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("kind").isNull() | F.col("kind").isin("click", "error"))
    return e, counts


_COUNTS = "c AS (SELECT kind, count(*) AS n FROM e WHERE kind IS NULL OR kind IN ('click', 'error') GROUP BY 1)"


@check("d2_null_safe_join", f"WITH e AS ({_FLAGGED}), {_COUNTS} SELECT event_id, e.kind, n FROM e JOIN c ON e.kind IS NOT DISTINCT FROM c.kind")
def _(t):
    e, counts = _per_kind(t)
    return joins.null_safe_join(e, counts, "kind").select("event_id", "kind", "n")


@check("d2_null_safe_full_join", f"""WITH e AS ({_FLAGGED}), {_COUNTS},
u AS (SELECT kind, CAST(user_id % 3 AS BIGINT) AS m, count(*) AS users FROM e WHERE kind IS NULL OR kind <> 'click' GROUP BY 1, 2)
SELECT coalesce(u.kind, c.kind) AS kind, m, users, n FROM u FULL JOIN c ON u.kind IS NOT DISTINCT FROM c.kind""")
def _(t):
    e, counts = _per_kind(t)
    u = (e.filter(F.col("kind").isNull() | (F.col("kind") != "click"))
         .groupBy("kind", (F.col("user_id") % 3).alias("m")).agg(F.count(F.lit(1)).alias("users")))
    return joins.null_safe_join(u, counts, "kind", "full")


@check("d3_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def _(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@check("d4_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.null_safe_join(t.customer, urgent, "c_custkey", "left_semi").select("c_custkey")


@check("d5_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(t):
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(returned, "o_orderkey", "left_anti").select("o_orderkey")


@check("d8_latest_parent", f"""WITH {HISTORY}
SELECT h.seq, max(p.seq) AS parent_seq FROM hist h LEFT JOIN hist p ON p.job = h.job AND p.step = 0 AND p.seq < h.seq GROUP BY 1""")
def _(t):
    return joins.latest_parent(t.history, "job", "seq", F.col("step") == 0, {"parent_seq": "seq"}).select("seq", "parent_seq")


@check("d9_first_row_per_group", "SELECT event_id, first_value(event_id) OVER w AS first_id, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return joins.first_row_per_group(t.events, "user_id", ["ts", "event_id"], {"first_id": "event_id", "first_type": "event_type"}).select(
        "event_id", "first_id", "first_type")


@check("d10_interval_agg", f"""WITH {HISTORY},
r AS (SELECT job, seq, lag(seq, 1, -1) OVER (PARTITION BY job ORDER BY seq) AS prev_seq FROM hist WHERE step = 0)
SELECT r.job, r.seq, count(*) AS n_rows, CAST(min(CASE WHEN h.status <> 1 THEN h.status END) AS BIGINT) AS worst
FROM r JOIN hist h ON h.job = r.job AND h.seq > r.prev_seq AND h.seq <= r.seq GROUP BY 1, 2""")
def _(t):
    out = joins.interval_agg(t.history, "job", "seq", F.col("step") == 0, {
        "seq": F.max(F.when(F.col("step") == 0, F.col("seq"))), "n_rows": F.count(F.lit(1)),
        "worst": F.min(F.when(F.col("status") != 1, F.col("status")))})
    return out.filter("seq IS NOT NULL").drop("interval_no")


@check("d11_group_flag", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS BIGINT) AS has_return FROM lineitem")
def _(t):
    return joins.group_flag(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R", "has_return", ["l_linenumber"]).select("l_orderkey", "l_linenumber", "has_return")


@check("d12_number_series", "SELECT p_partkey, CAST(n AS BIGINT) AS n FROM part, LATERAL (SELECT unnest(generate_series(CAST(p_size % 5 AS BIGINT), 3)) AS n)")
def _(t):
    return joins.with_number_series(t.part, F.col("p_size") % 5, F.lit(3)).select("p_partkey", "n")


@check("d13_unnest", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def _(t):
    return joins.unnest(t.part, F.split("p_name", " "), "word").select("p_partkey", "word")


@check("d13_unnest_outer", "SELECT p_partkey, word FROM part LEFT JOIN LATERAL (SELECT unnest(CASE WHEN p_size > 25 THEN string_split(p_name, ' ') END) AS word) ON true")
def _(t):
    return joins.unnest(t.part, F.when(F.col("p_size") > 25, F.split("p_name", " ")), "word", keep_empty=True).select("p_partkey", "word")


@check("d14_with_scalar", f"SELECT s_suppkey, (SELECT count(DISTINCT n_regionkey) FROM nation) AS regions, {day('(SELECT max(o_orderdate) FROM orders)')} AS newest FROM supplier")
def _(t):
    s = joins.with_scalar(t.supplier.select("s_suppkey"), t.nation, {"regions": F.count_distinct("n_regionkey")})
    return joins.with_scalar(s, t.orders, {"newest": F.to_date(F.max("o_orderdate"))})


@check("d15_wildcard_join", """WITH spec AS (SELECT DISTINCT CASE WHEN p_size < 4 THEN p_brand END AS p_brand, CASE WHEN p_size < 4 AND p_size > 1 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_size < 5 AND p_brand <> 'Brand#7' AND p_type <> 'SMALL')
SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM spec s WHERE (s.p_brand IS NULL OR s.p_brand = p.p_brand) AND (s.p_type IS NULL OR s.p_type = p.p_type))""")
def _(t):
    small = t.part.filter("p_size < 5 AND p_brand <> 'Brand#7' AND p_type <> 'SMALL'")
    spec = small.select(F.when(F.col("p_size") < 4, F.col("p_brand")).alias("p_brand"),
                        F.when((F.col("p_size") < 4) & (F.col("p_size") > 1), None).otherwise(F.col("p_type")).alias("p_type")).distinct()
    return joins.wildcard_join(t.part, spec, ["p_brand", "p_type"]).select("p_partkey")


@check("d16_group_bounds", f"""WITH {STATE}
SELECT entity, key, value, {at('min(valid_from) OVER w')} AS first_from, {at('max(valid_from) OVER w')} AS last_from FROM state WINDOW w AS (PARTITION BY entity)""")
def _(t):
    return joins.group_bounds(t.state.select("entity", "key", "value", "valid_from"), "entity", {
        "first_from": F.min("valid_from"), "last_from": F.max("valid_from")}).drop("valid_from")


@check("e1_grouped", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(CAST(l_quantity AS BIGINT)) AS mean_quantity FROM lineitem GROUP BY 1, 2""")
def _(t):
    q = F.col("l_quantity").cast("bigint")
    return aggregate.grouped(t.lineitem, ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), quantity=F.sum(q),
                             low=F.min("l_extendedprice"), high=F.max("l_extendedprice"), mean_quantity=F.avg(q))


@check("e2_union_grouped", """SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(o_custkey % 50 AS BIGINT) AS key, 1 AS n FROM orders
UNION ALL SELECT CAST(c_nationkey AS BIGINT), 10 FROM customer) GROUP BY 1""")
def _(t):
    live = t.orders.select((F.col("o_custkey") % 50).alias("key"), F.lit(1).alias("n"))
    kept = t.customer.select(F.col("c_nationkey").cast("bigint").alias("key"), F.lit(10).alias("n"))
    return aggregate.union_grouped(live, kept, "key", n=F.sum("n"))


@check("e3_by_type", f"""SELECT o_custkey, {at("max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END)")} AS last_full,
{at("max(CASE WHEN o_orderstatus = 'P' THEN o_orderdate END)")} AS last_partial FROM orders GROUP BY 1""")
def _(t):
    return aggregate.by_type(t.orders, "o_custkey", "o_orderstatus", {"last_full": "F", "last_partial": "P"}, F.max, "o_orderdate")


@check("e4_share_of_total", """WITH h AS (SELECT user_id % 20 AS entity, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
SELECT entity, strftime(h, '%Y-%m-%d %H:%M:%S') AS h, n / CAST(sum(n) OVER (PARTITION BY h) AS DOUBLE) AS share FROM h""")
def _(t):
    h = t.events.groupBy((F.col("user_id") % 20).alias("entity"), F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return aggregate.share_of_total(h, "n", "h").drop("n")


@check("e5_collapse", "SELECT l_orderkey, l_returnflag, count(*) AS files FROM lineitem GROUP BY 1, 2")
def _(t):
    return aggregate.collapse(t.lineitem, ["l_orderkey", "l_returnflag"])


@check("e6_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@check("e7_distinct_count", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    return aggregate.distinct_count(t.events, "user_id", "users", "event_type")


@check("e8_text_of_parts", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").cast("string").alias("p"))
    return aggregate.text_of_parts(rows, "l_orderkey", "p", ["l_linenumber", "l_partkey"], "parts")


@check("e9_hourly_rollup", f"""WITH {HISTORY} SELECT job, CAST(status AS BIGINT) AS status, {day('started')} AS date, hour(started) AS hour, count(*) AS cnt,
CAST(sum(duration_s) AS BIGINT) AS sum_s, min(duration_s) AS min_s, max(duration_s) AS max_s FROM hist GROUP BY 1, 2, 3, 4""")
def _(t):
    return aggregate.hourly_rollup(t.history, ["job", "status"], "started", "duration_s")


@check("g1_order_and_top", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def _(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@check("g2_union_all", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")).unionByName(
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@check("g3_union_distinct", "SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
def _(t):
    return reshape.union_distinct(t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation")))


@check("g4_pivot_state", f"""WITH {STATE} SELECT entity, max(CASE WHEN key = 'status' THEN value END) AS status,
max(CASE WHEN key = 'priority' THEN value END) AS priority, {at('max(valid_from)')} AS since FROM state WHERE valid_to = TIMESTAMP '9999-12-31 23:59:59' GROUP BY 1""")
def _(t):
    from ...operators.select import current_rows
    return reshape.pivot_state(current_rows(t.state), "entity", ["status", "priority"], extra={"since": F.max("valid_from")})


@check("g4_pivot_state_typed", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS \"view\" FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(t):
    e = t.events.select("user_id", F.col("event_type").alias("key"),
                        F.when(F.col("event_type") == "click", F.lpad(F.floor("value").cast("string"), 8, "0"))
                        .otherwise(F.format_string("%012.2f", "value")).alias("value"))
    return reshape.pivot_state(e, "user_id", {"click": "bigint", "view": "double"})


_SLOTS = ", ".join(f"max(CASE WHEN hour(ts) = {h} THEN event_type END) AS h{h:02d}" for h in range(24))


@check("g5_pivot_slots", f"SELECT user_id, {_SLOTS} FROM events GROUP BY 1")
def _(t):
    return reshape.pivot_slots(t.events.select("user_id", F.hour("ts").alias("hour"), "event_type"), "user_id", "hour", range(24), "event_type")


@check("g6_unpivot_state", """SELECT o_orderkey, 'o_orderstatus' AS key, o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders""")
def _(t):
    o = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return reshape.unpivot_state(o, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@check("g7_inline_table", "SELECT label, count(*) AS n FROM orders JOIN (VALUES ('O', 'Open'), ('F', 'Filled')) AS v(code, label) ON code = o_orderstatus GROUP BY 1")
def _(t):
    v = reshape.inline_table(t.spark, "code string, label string", [("O", "Open"), ("F", "Filled")])
    return t.orders.join(v, F.col("code") == F.col("o_orderstatus")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
