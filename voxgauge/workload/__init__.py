"""Registered queries: the engine's operators on the driver tables, each with an equivalent DuckDB statement."""

from __future__ import annotations

from voxgauge.workload import audit_queries, composed_queries, match_queries, run_queries, signal_queries, task_queries

_MODULES = (task_queries, composed_queries, match_queries, signal_queries, audit_queries, run_queries)


def all_queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def all_checks() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
