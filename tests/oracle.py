"""Compare registered queries with their SQL on one data folder.

Also a script: ``python tests/oracle.py [folder] [name pattern]``.
"""

from __future__ import annotations

import math
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "" if v is None else f"{type(v).__name__}:{v}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def differences(spark, con, folder, query, sql) -> tuple[int, str | None]:
    df = query(spark, folder)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    kind = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    off = {c: (t, types[c]) for c, t in df.dtypes if kind.get(t) not in (types[c], None) and types[c] not in ("NUMBER", "STRING")}
    if off:
        return len(got), f"types {off}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return len(got), f"rows {len(a)} vs {len(b)}; columns {sorted(names)}; only spark {only_a}; only sql {only_b}"
    return len(got), None


def main():
    from pulsemill.plans.checks import ORACLE, QUERIES
    from pulsemill.session import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, query in QUERIES.items():
        if not pattern.search(name):
            continue
        t = time.time()
        try:
            n, diff = differences(spark, con, folder, query, ORACLE[name]) if name in ORACLE else (query(spark, folder).count(), None)
        except Exception as e:  # noqa: BLE001 - a report of all failures is the point
            n, diff = -1, f"{type(e).__name__} {str(e)[:1200]}"
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("failures", bad, "of", len(QUERIES))


if __name__ == "__main__":
    main()
