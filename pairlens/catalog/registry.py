"""The list of registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

_MODULES = ("inputs", "features", "alignment", "connectivity", "metrics", "weights", "reports", "estimators", "wide", "prediction")


def register(name: str, sql: str | None = None):
    """Add a query under `name` with its SQL, or without one where SQL is no option."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"pairlens.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
