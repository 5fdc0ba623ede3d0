"""The registry of this subpackage's queries."""

from __future__ import annotations

from assetflow.queries.base import Query

LLM_QUERIES: dict[str, Query] = {}


def llm_query(name: str, sql: str | None = None):
    def add(fn):
        if name in LLM_QUERIES:
            raise ValueError(f"query {name} registered twice")
        LLM_QUERIES[name] = Query(fn, sql)
        return fn

    return add
