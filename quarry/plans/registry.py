"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under a name, with the SQL it is compared with."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


for _part in ("aggregate_queries", "join_queries", "text_queries", "graph_queries", "code_queries", "flow_queries", "support_queries", "application_queries", "report_queries", "stream_queries", "more_queries", "name_queries"):
    import_module(f"quarry.plans.{_part}")
