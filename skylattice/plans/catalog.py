"""All queries of the core, and the SQL that each must equal."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLES.
MODULES = ("problems", "temporal_queries", "geo_queries", "sequence_queries", "filter_queries", "flight_queries", "scan_queries", "search_queries", "dataset_queries", "state_queries")


def collect(modules: tuple[str, ...] = MODULES) -> tuple[dict, dict]:
    """(queries, SQL) of the modules."""
    queries: dict = {}
    oracles: dict = {}
    for name in modules:
        m = import_module(f"skylattice.plans.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
