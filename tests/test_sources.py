"""A: reading, stamping, idempotent writes, tolerance dedup."""

import random

from helpers import frame, rows, ts
from pyspark.sql import functions as F

from pulsemill.sources import event_files, snapshots


def test_absent_optional_columns_become_typed_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, "NAME string, value int", [("a", 1)]).write.parquet(path)
    got = snapshots.read_snapshots(spark, path, "gauges")
    assert got.dtypes == [("name", "string"), ("value", "bigint"), ("ts_utc", "timestamp"), ("ts", "timestamp")]
    assert rows(got, "name", "value", "ts") == [("a", 1, None)]


def test_stamp_keeps_two_clocks(spark):
    got = snapshots.stamp(spark.range(1), F.lit(ts(0)).cast("timestamp"), "Europe/Copenhagen")
    assert rows(got, "ts_utc", "ts") == [(ts(0), ts(1))]


def test_insert_if_absent_is_idempotent(spark):
    new = frame(spark, "k string, v int", [("a", 1), (None, 2), ("b", 3)])
    old = frame(spark, "k string, v int", [("a", 0), (None, 0)])
    once = old.unionByName(snapshots.insert_if_absent(new, old, "k"))
    assert rows(once, "k", "v") == [("a", 0), ("b", 3), (None, 0)]
    assert snapshots.insert_if_absent(new, once, "k").count() == 0


def test_neighbours_against_brute_force(spark):
    r = random.Random(5)
    new = [(i, r.choice("ab"), ts(0, milliseconds=r.randrange(10 ** 6))) for i in range(300)]
    old = [(r.choice("ab"), ts(0, milliseconds=r.randrange(10 ** 6))) for _ in range(60)]
    edge = [(1000, "a", ts(1)), (1001, "a", ts(1, seconds=0.001)), (1002, "b", ts(1))]
    old.append(("a", ts(1, seconds=5)))
    n, o = frame(spark, "id int, k string, ts timestamp", new + edge), frame(spark, "k string, ts timestamp", old)
    for by in ((), ("k",)):
        want = [(i,) for i, k, t in new + edge
                if not any(abs((t - u).total_seconds()) <= 5 and (not by or k == j) for j, u in old)]
        assert rows(snapshots.insert_if_no_neighbour(n, o, "ts", 5, by), "id") == sorted(want)


def test_read_since_with_null_entity_and_without_mark(spark):
    df = frame(spark, "k string, ts timestamp", [("a", ts(1)), ("a", ts(2)), (None, ts(1)), ("new", ts(0))])
    wm = frame(spark, "k string, ts timestamp", [("a", ts(2)), (None, ts(5))])
    assert rows(snapshots.read_since(df, wm, "k", "ts")) == [("a", ts(2)), ("new", ts(0))]
    assert rows(snapshots.read_since(df, wm, "k", "ts", inclusive=False)) == [("new", ts(0))]


def test_write_partition_replaces_only_its_snapshots(spark, tmp_path):
    path = str(tmp_path / "p")
    snapshots.write_partition(frame(spark, "v int, ts_utc timestamp", [(1, ts(0)), (2, ts(1))]), path)
    for _ in range(2):
        snapshots.write_partition(frame(spark, "v int, ts_utc timestamp", [(7, ts(1)), (8, ts(1))]), path)
    assert rows(spark.read.parquet(path), "v") == [(1,), (7,), (8,)]


def test_snapshots_of_an_hour_share_a_folder(spark, tmp_path):
    path = str(tmp_path / "p")
    for minute in (0, 10, 20, 10):
        snapshots.write_partition(frame(spark, "v int, ts_utc timestamp", [(minute, ts(5, minutes=minute)), (-minute, ts(7, minutes=minute))]), path)
    assert len(list((tmp_path / "p").glob("date=*/hour=*"))) == 2
    assert rows(spark.read.parquet(path), "v") == sorted((v,) for m in (0, 10, 20) for v in (m, -m))


def test_append_prunes_by_day(spark, tmp_path):
    path = str(tmp_path / "a")
    snapshots.append_snapshot(frame(spark, "v int, ts_utc timestamp", [(1, ts(0)), (2, ts(30))]), path, sort=["v"])
    day = spark.read.parquet(path).filter("date = '2024-01-02'")
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().toString()
    assert rows(day, "v") == [(2,)]


def test_replace_days_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "date date, v int"
    snapshots.replace_days(frame(spark, schema, [(ts(0).date(), 1), (ts(24).date(), 2)]), path)
    snapshots.replace_days(frame(spark, schema, [(ts(24).date(), 9)]), path)
    assert rows(spark.read.parquet(path), "v") == [(1,), (9,)]
    # A table may be rewritten from itself.
    snapshots.replace_days(spark.read.parquet(path).select("date", (F.col("v") + 1).alias("v")).filter("date = '2024-01-02'"), path)
    assert rows(spark.read.parquet(path), "v") == [(1,), (10,)]


def test_backfill_writes_few_files_per_day(spark, tmp_path):
    path = str(tmp_path / "b")
    many = spark.range(0, 4000, numPartitions=16).select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 4 * 86400).alias("ts_utc"))
    snapshots.append_snapshot(many, path, sort=["id"], spread=True)
    back = spark.read.parquet(path)
    assert back.count() == 4000 and len(back.inputFiles()) <= 8


def test_unselected_services_come_back_empty_with_their_schema(spark):
    t = frame(spark, "a int, b string", [(1, "x")])
    got = snapshots.select_services(["kept"], {"kept": t, "other": t})
    assert got["kept"].count() == 1 and got["other"].count() == 0 and got["other"].schema == t.schema


def test_event_files_are_read_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "id bigint, event_ts timestamp, file string, offset bigint, event_data string"
    for i in range(3):
        frame(spark, schema, [(i, ts(i), "f", i, "<event/>")]).write.mode("append").parquet(src)
        event_files.resume_event_files(spark, src, out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == i + 1
    event_files.resume_event_files(spark, src, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_files_of_two_generations_keep_the_optional_column(spark, tmp_path):
    # Whichever file comes first, and whichever has the column.
    for name, order in (("a", (0, 1)), ("b", (1, 0))):
        path = str(tmp_path / name)
        old, new = frame(spark, "name string, value int", [("x", 1)] * 3), frame(spark, "name string, value bigint, note string", [("y", 2 ** 40, "n")] * 3)
        for i in order:
            (old, new)[i].coalesce(1).write.mode("append").parquet(path)
        got = snapshots.read_snapshots(spark, path, "name string, value bigint, note string, gone double")
        assert rows(got) == [("x", 1, None, None)] * 3 + [("y", 2 ** 40, "n", None)] * 3
    part = frame(spark, "name string, value bigint", [("x", 1)])
    part.write.parquet(str(tmp_path / "c"))
    assert snapshots.absent_columns(spark, str(tmp_path / "c"), "name string, note string, value bigint") == ["note"]


def test_wider_files_are_cast_when_footers_are_merged(spark, tmp_path):
    path = str(tmp_path / "w")
    frame(spark, "name string, value bigint", [("x", 7)]).write.parquet(path)
    frame(spark, "name string, other string", [("y", "o")]).write.mode("append").parquet(path)
    got = snapshots.read_snapshots(spark, path, "name string, value int, other string", reconcile="merged")
    assert got.dtypes[1] == ("value", "int") and rows(got) == [("x", 7, None), ("y", None, "o")]


def test_write_partition_keeps_columns_of_older_files(spark, tmp_path):
    path = str(tmp_path / "p")
    snapshots.write_partition(frame(spark, "v int, ts_utc timestamp", [(1, ts(0, minutes=1))]), path)
    snapshots.write_partition(frame(spark, "v int, note string, ts_utc timestamp", [(2, "n", ts(0, minutes=2))]), path)
    snapshots.write_partition(frame(spark, "v int, ts_utc timestamp", [(3, ts(0, minutes=3)), (9, ts(30))]), path)
    back = spark.read.option("mergeSchema", "true").parquet(path)
    assert rows(back, "v", "note") == [(1, None), (2, "n"), (3, None), (9, None)]


def test_bounds_of_watermarks_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "h")
    frame(spark, "k string, ts timestamp", [(k, ts(i)) for i in range(50) for k in "abc"]).write.parquet(path)
    df = spark.read.parquet(path)
    wm = frame(spark, "k string, ts timestamp", [("a", ts(40)), ("b", ts(45))])
    got = snapshots.read_since(df, wm, "k", "ts", unmarked_from=F.lit(ts(48)))
    assert rows(got.groupBy("k").count()) == [("a", 10), ("b", 5), ("c", 2)]
    plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x]
    assert pushed and all("GreaterThanOrEqual(ts" in x for x in pushed)


def _set(path, text, append=False):
    with open(path, "a" if append else "w") as f:
        f.write(text)


def test_rows_appended_to_a_known_file_arrive_once(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    run = lambda: event_files.resume_event_files(spark, str(src), out, ck, "id bigint, note string", "json").awaitTermination()
    ids = lambda: rows(event_files.GrowingFiles(spark, str(src), out, ck, "id bigint, note string", "json").read(), "id")
    _set(src / "f1", '{"id": 1, "note": "a"}\n')
    run()
    _set(src / "f1", '{"id": 2, "note": "a"}\n{"id": 2, "note": "a"}\n', append=True)
    _set(src / "f 2%", '{"id": 9}\n')
    for _ in range(2):
        run()
        assert ids() == [(1,), (2,), (2,), (9,)]
    _set(src / "f1", '{"id": 3}\n{"id": 4, "no', append=True)  # half a line
    run()
    assert ids() == [(1,), (2,), (2,), (3,), (9,)]
    _set(src / "f1", 'te": "z"}\n', append=True)
    run()
    assert ids() == [(1,), (2,), (2,), (3,), (4,), (9,)]
    _set(src / "f1", '{"id": 50}\n')  # replaced: another file of that name
    run()
    assert ids() == [(1,), (2,), (2,), (3,), (4,), (9,), (50,)]


def test_a_step_that_dies_before_its_commit_is_done_anew(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    files = event_files.GrowingFiles(spark, str(src), out, ck, "id bigint", "csv", max_files=1)
    for i in range(3):
        _set(src / f"f{i}", f"{i}\n{i + 10}\n")
    assert files.advance() == 3 and files.advance() == 0
    # A batch without a commit, as a crash leaves it.
    _set(src / "f1", "77\n", append=True)
    frame(spark, "id bigint", [(-1,)]).write.parquet(f"{out}/batch=3")
    assert rows(files.read(), "id") == [(0,), (1,), (2,), (10,), (11,), (12,)]
    assert files.advance() == 1
    assert rows(files.read(), "id") == [(0,), (1,), (2,), (10,), (11,), (12,), (77,)]


def test_the_index_of_files_is_written_whole_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_files, "WHOLE_INDEX", 2)
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    files = event_files.GrowingFiles(spark, str(src), out, ck, "id bigint", "json")
    for i in range(5):
        for f in "ab"[:1 + i % 2]:
            _set(src / f, f'{{"id": {i}}}\n', append=True)
        assert files.advance() == 1
    assert rows(files.read(), "id") == [(0,), (1,), (1,), (2,), (3,), (3,), (4,)]


def test_large_text_files_are_placed_over_their_splits(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        files = event_files.GrowingFiles(spark, str(src), out, ck, "id bigint", "json")
        for part in range(3):
            _set(src / "f", "".join(f'{{"id": {part * 1000 + i}}}\n' for i in range(1000)), append=True)
            files.advance()
        assert rows(files.read(), "id") == [(i,) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_retention_drops_day_folders_unread(spark, tmp_path):
    import random

    from pulsemill.operators.state import apply_retention
    r = random.Random(3)
    data = [(i, r.choice("LD"), ts(24 * r.randrange(40) + r.randrange(24) + 24 * 60)) for i in range(400)] + [(999, "D", ts(24 * 100, minutes=30))]
    data = [x for x in data if not (x[1] == "L" and 85 <= (x[2] - ts(0)).days <= 88)]  # days without anything to drop
    path, rules = str(tmp_path / "t"), [(20, None), (7, F.col("k") == "L")]
    df = frame(spark, "id int, k string, ts timestamp", data)
    snapshots.append_snapshot(df, path, "ts", spread=True)
    old = sorted(p.name for p in (tmp_path / "t").glob("date=*"))
    for p in (tmp_path / "t" / old[0]).glob("*.parquet"):
        p.write_bytes(b"no parquet at all")  # reading it would fail
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("date=*/*.parquet")}
    gone, rewritten = snapshots.retain_days(spark, path, "ts", rules)
    want = apply_retention(df, "ts", rules)
    assert rows(spark.read.parquet(path), "id") == rows(want, "id")
    assert old[0][5:] in gone and rewritten and not set(gone) & set(rewritten)
    for p, when in files.items():
        day = p.parent.name[5:]
        if day not in gone and day not in rewritten:
            assert p.stat().st_mtime_ns == when
    assert "2024-03-27" not in rewritten and snapshots.retain_days(spark, path, "ts", rules) == ([], [])
    assert snapshots.retain_days(spark, str(tmp_path), "ts", rules) == ([], [])
