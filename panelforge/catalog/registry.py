"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name, with the SQL it must agree with."""

    def add(run):
        if run.__name__ in REGISTRY:
            raise ValueError(f"{run.__name__} is registered twice")
        REGISTRY[run.__name__] = Query(run, sql, covers)
        return run

    return add
