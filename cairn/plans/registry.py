"""A registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with an optional ANSI SQL oracle."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under ``name`` (its own name by default)."""

        def add(function: Query) -> Query:
            key = name or function.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is registered twice")
            self.queries[key] = function
            if sql is not None:
                self.oracles[key] = sql
            return function

        return add
