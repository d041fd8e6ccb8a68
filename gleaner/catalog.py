"""Registry of the engine's queries: name, callable and DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    """Add the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(run, sql, ops)
        return run

    return add


def load() -> dict[str, Query]:
    from gleaner.plans import load_all

    load_all()
    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query.run for name, query in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: query.sql for name, query in load().items() if query.sql}
