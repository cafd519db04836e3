"""Sources and sinks: A."""

from pyspark.sql import functions as F

from ...session import scratch_dir
from ...sources import event_files, snapshots
from . import at, check, day

_OPTIONAL = "l_orderkey bigint, l_partkey bigint, l_shipdate timestamp, l_comment string, l_rating double"


@check("a1_read_snapshots", "SELECT l_partkey % 10 AS grp, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS comments FROM lineitem GROUP BY 1")
def _(t):
    rows = snapshots.read_snapshots(t.spark, f"{t.folder}/lineitem.parquet", _OPTIONAL)
    return rows.groupBy((F.col("l_partkey") % 10).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.count("l_comment").alias("comments"))


@check("a1_read_json_and_csv", "SELECT s_suppkey, s_name, s_acctbal, CAST(NULL AS VARCHAR) AS s_note, 'json' AS fmt FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'csv' FROM supplier")
def _(t):
    out, schema = None, "s_suppkey bigint, s_name string, s_acctbal double, s_note string"
    for fmt in ("json", "csv"):
        path = scratch_dir(t.spark, f"supplier-{fmt}")
        t.supplier.select("s_suppkey", "s_name", "s_acctbal", F.lit(None).cast("string").alias("s_note")).write.format(fmt).save(path)
        rows = snapshots.read_snapshots(t.spark, path, schema, fmt).withColumn("fmt", F.lit(fmt))
        out = rows if out is None else out.unionByName(rows)
    return out


@check("a1_two_generations", f"""SELECT {day('ts')} AS date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(CASE WHEN event_id % 2 = 1 THEN 1 END) AS notes,
CAST(count(CASE WHEN event_id % 2 = 1 THEN user_id END) AS BIGINT) AS users FROM events GROUP BY 1""")
def _(t):
    """Even events were collected before the columns note and user_id came, with narrower numbers."""
    path = scratch_dir(t.spark, "generations")
    old = t.events.filter("event_id % 2 = 0").select(F.col("event_id").cast("int").alias("event_id"), "ts")
    new = t.events.filter("event_id % 2 = 1").select("event_id", "ts", F.lit("x").alias("note"), "user_id")
    old.write.parquet(path)
    new.write.mode("append").parquet(path)
    rows = snapshots.read_snapshots(t.spark, path, "event_id bigint, ts timestamp, note string, user_id bigint, never double")
    return rows.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count("note").alias("notes"), F.count("user_id").alias("users"))


@check("a2_stamp", f"SELECT o_orderkey, {at('o_orderdate')} AS ts_utc, {at('o_orderdate + INTERVAL 2 HOUR')} AS ts FROM orders")
def _(t):
    return snapshots.stamp(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderdate"), "Etc/GMT-2").drop("o_orderdate")


@check("a3_append_snapshot", f"SELECT {day('ts')} AS date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(t):
    path = scratch_dir(t.spark, "append")
    e = t.events.select("event_id", F.col("ts").alias("ts_utc"))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        snapshots.append_snapshot(e.filter(part), path, sort=["event_id"])
    return t.spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@check("a4_insert_if_absent", """WITH k AS (SELECT DISTINCT user_id, nullif(event_type, 'view') AS kind FROM events WHERE user_id % 2 = 0 AND event_type IN ('view', 'click'))
SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND k.kind IS NOT DISTINCT FROM nullif(e.event_type, 'view'))""")
def _(t):
    e = t.events.withColumn("kind", F.nullif("event_type", F.lit("view")))
    known = e.filter("user_id % 2 = 0 AND (kind IS NULL OR kind = 'click')")
    return snapshots.insert_if_absent(e, known, ["user_id", "kind"]).select("event_id")


@check("a5_insert_if_no_neighbour", """SELECT event_id FROM events n WHERE event_type <> 'purchase'
AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.ts BETWEEN n.ts - INTERVAL 600 SECOND AND n.ts + INTERVAL 600 SECOND)""")
def _(t):
    e = t.events
    return snapshots.insert_if_no_neighbour(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'"), "ts", 600).select("event_id")


@check("a5_insert_if_no_neighbour_by_user", """SELECT event_id FROM events n WHERE event_type <> 'purchase'
AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = n.user_id AND e.ts BETWEEN n.ts - INTERVAL 7200 SECOND AND n.ts + INTERVAL 7200 SECOND)""")
def _(t):
    e = t.events
    return snapshots.insert_if_no_neighbour(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'"), "ts", 7200, "user_id").select("event_id")


@check("a6_resume_event_files", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(t):
    root = scratch_dir(t.spark, "resume")
    schema = t.events.schema
    for _ in range(2):  # the second run finds nothing new
        event_files.resume_event_files(t.spark, t.folder, f"{root}/out", f"{root}/checkpoint", schema,
                                       pathGlobFilter="events.parquet").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@check("a6_growing_files", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(t):
    """Four files that grow: each run writes them again with a third more of their rows behind the others."""
    root, spark = scratch_dir(t.spark, "growing"), t.spark
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files = event_files.GrowingFiles(spark, f"{root}/events", f"{root}/out", f"{root}/checkpoint", t.events.schema)
    fs.mkdirs(path(f"{root}/events"))
    third = t.events.withColumn("part", F.pmod("event_id", F.lit(4))).withColumn(
        "run", F.floor(F.col("event_id") * 3 / (t.events.select(F.max("event_id")).scalar() + 1)) + 1)
    for run in (1, 2, 3, 3):  # the last run finds nothing new
        if run != 3 or files.committed() < 3:
            staged = f"{root}/staged-{run}"
            third.filter(F.col("run") <= run).drop("run").repartition(4, "part").sortWithinPartitions("part", "event_id").write.partitionBy("part").parquet(staged)
            for part in range(4):
                written = fs.globStatus(path(f"{staged}/part={part}/*.parquet"))
                fs.delete(path(f"{root}/events/f{part}"), False)
                fs.rename(written[0].getPath(), path(f"{root}/events/f{part}"))
        files.advance()
    return files.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


_WM = "wm AS (SELECT user_id, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-12' AND user_id % 4 <> 0 GROUP BY 1)"


@check("a7_read_since_inclusive", f"WITH {_WM} SELECT event_id FROM events LEFT JOIN wm USING (user_id) WHERE mark IS NULL OR ts >= mark")
def _(t):
    return _since(t, True)


@check("a7_read_since_exclusive", f"WITH {_WM} SELECT event_id FROM events LEFT JOIN wm USING (user_id) WHERE mark IS NULL OR ts > mark")
def _(t):
    return _since(t, False)


def _since(t, inclusive):
    e = t.events
    wm = e.filter((F.col("ts") < F.lit("2024-01-12").cast("timestamp")) & (F.col("user_id") % 4 != 0)).groupBy("user_id").agg(F.max("ts").alias("mark"))
    return snapshots.read_since(e, wm, "user_id", "ts", inclusive, "mark").select("event_id")


@check("a8_write_partition", f"SELECT {at("date_trunc('month', o_orderdate)")} AS ts_utc, count(*) AS n, CAST(sum(CASE WHEN o_orderdate >= TIMESTAMP '2001-06-01' THEN -o_orderkey ELSE o_orderkey END) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(t):
    path = scratch_dir(t.spark, "partition")
    o = t.orders.select("o_orderkey", F.date_trunc("month", "o_orderdate").alias("ts_utc"))
    redo = o.filter(F.col("ts_utc") >= F.lit("2001-06-01").cast("timestamp")).withColumn("o_orderkey", -F.col("o_orderkey"))
    snapshots.write_partition(o, path, spread=True)
    for _ in range(2):  # run again: same content
        snapshots.write_partition(redo, path, spread=True)
    return t.spark.read.parquet(path).groupBy("ts_utc").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@check("a9_select_services", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', 0")
def _(t):
    chosen = snapshots.select_services(["orders"], {"orders": t.orders, "customer": t.customer})
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in chosen.items()]
    return counts[0].unionByName(counts[1])
