"""Every registered query against its oracle, and what its plan may not contain."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from assetflow.queries import REGISTRY
from tools.check import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    got = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(frame.columns) == sorted(names)
    assert canonical(frame.columns, got) == canonical(names, want)


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(QUERIES)
    assert all(q.sql for q in REGISTRY.values())


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["estimate_sizes"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]
