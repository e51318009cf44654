"""All queries of the engine by name."""

from __future__ import annotations

from quern.plans import aggregate_plans, chunk_plans, dml_plans, engine_plans, graph_plans, lifecycle_plans, memory_plans, ranking_plans, record_plans, retrieval_plans, stream_plans  # noqa: F401
from quern.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
