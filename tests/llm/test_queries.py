"""Registered queries of this subpackage against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from assetflow.llm.queries import LLM_QUERIES
from tests.llm.helpers import SF
from tools.check import TABLES, canonical


NATIVE = ["op3_chat_format", "op5_source_mix", "op8_url_filter", "op10_license_scan"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n, q in LLM_QUERIES.items() if q.sql])
def test_query_matches_oracle(spark, con, name):
    frame = LLM_QUERIES[name].run(spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    if name in NATIVE:
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    cursor = con.execute(LLM_QUERIES[name].sql)
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert canonical(frame.columns, frame.collect()) == canonical(names, cursor.fetchall())


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES)
    assert numbers == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())
