"""Registered queries against their SQL, and the guard around the subpackage."""

import os
import subprocess
import sys

import pytest

import oracle
from pulsemill.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, con, name):
    rows, difference = oracle.differences(spark, con, FOLDER, queries.QUERIES[name], queries.ORACLE[name])
    assert rows and difference is None


def test_sharding_with_a_small_limit(spark, con, monkeypatch):
    limit = 1 << 16
    sql = queries.ORACLE["op3_sharding"].replace(str(queries.SHARD_BYTES), str(limit))
    monkeypatch.setattr(queries, "SHARD_BYTES", limit)
    assert oracle.differences(spark, con, FOLDER, queries.QUERIES["op3_sharding"], sql)[1] is None


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py", "pulsemill"):
        os.symlink(os.path.join(root, name), tmp_path / name)
    code = "import sys; sys.modules['pulsemill.llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    n, any_op, _ = said.stdout.split()
    assert int(n) >= 180 and any_op == "False"
