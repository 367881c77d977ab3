"""All registered queries of the engine proper, and SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir); sql states the same result for comparison."""

    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def _load() -> None:
    from . import graph_plans, maintenance_plans, relational_plans, retrieval_plans, text_plans  # noqa: F401


_load()
