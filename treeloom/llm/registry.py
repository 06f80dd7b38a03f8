"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from treeloom.llm import cluster_queries, overlap_queries, packing_queries, quality_queries, splitting_queries, token_queries

_MODULES = [overlap_queries, splitting_queries, cluster_queries, token_queries, packing_queries, quality_queries]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
