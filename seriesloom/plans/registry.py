"""One place that keeps each query next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.plans.bindings import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name`` with its oracle SQL, if any."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        _MODULE[name] = build.__module__.rsplit(".", 1)[-1]
        if sql:
            _SQL[name] = sql
        return build

    return register


def load() -> None:
    """Import every module that registers queries."""
    from seriesloom.plans import (  # noqa: F401
        expression,
        flows,
        intervals,
        modelling,
        pairs,
        sets,
        sources,
        statistics,
        tables,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)


def module_of(name: str) -> str:
    load()
    return _MODULE.get(name, "llm")
