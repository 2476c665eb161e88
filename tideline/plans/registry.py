"""Registration of queries and of the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("variations", "positions", "windows", "loads", "gates", "adjusted")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        label = name or fn.__name__
        if label in _QUERIES:
            raise ValueError(f"query {label} is registered twice")
        _QUERIES[label] = fn
        if sql is not None:
            _ORACLES[label] = sql
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"tideline.plans.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
