"""Registered queries: every operator on the given tables, with equivalent SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregate, builders, ensemble, folds, keyed, learn, projection, rare, reports, scaling, sources

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [sources, projection, keyed, aggregate, folds, rare, builders, scaling, ensemble, learn, reports]


def all_queries() -> dict[str, Query]:
    return {name: fn for module in _MODULES for name, fn in module.CHECKS.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.CHECKS.sql.items()}
