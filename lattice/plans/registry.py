"""Names, plans and SQL twins of the relational, text, vector and timeline queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattice.plans.twins import TWINS

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its twin in DuckDB's dialect (those of folds stand in ``twins``)."""
    sql = sql or TWINS.get(name)

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return register


#: Modules of this folder that register queries when they are imported.
MODULES = ("relational", "search", "texts", "timeline", "vectors", "trees", "control", "rules", "more", "service", "tables")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lattice.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
