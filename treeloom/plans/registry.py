"""All core queries and their SQL."""

from __future__ import annotations

from treeloom.plans import cluster_queries, hierarchy_queries, pipeline_queries, pooling_queries, record_queries, source_queries

_MODULES = [record_queries, hierarchy_queries, pooling_queries, cluster_queries, source_queries, pipeline_queries]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
