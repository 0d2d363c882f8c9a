"""The registered queries: one per operator, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import VIEWS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_FAMILIES = [
    "source_checks",
    "clean_checks",
    "rule_checks",
    "join_checks",
    "aggregate_checks",
    "window_checks",
    "sampling_checks",
    "function_checks",
    "guard_checks",
    "retrieval_checks",
    "model_checks",
    "streaming_checks",
    "job_checks",
    "model_facts",
]


def query(name: str, sql: str | None = None, views: str = "", ctes: str = "") -> Callable[[Query], Query]:
    """Register a query; `views` names the bindings its SQL needs, `ctes` adds more."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            heads = [VIEWS_SQL[v] for v in views.split()]
            if ctes:
                heads.append(ctes)
            SQL[name] = (f"WITH {', '.join(heads)} " if heads else "") + sql
        return fn

    return keep


def load() -> None:
    for family in _FAMILIES:
        import_module(f"{__name__}.{family}")
