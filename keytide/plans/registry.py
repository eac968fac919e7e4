"""Registry of named queries: a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, in the order they were added."""

    def __init__(self) -> None:
        self.queries: dict[str, Run] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        """Decorator that registers a query under ``name``."""

        def put(run: Run) -> Run:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = run
            if sql:
                self.oracles[name] = sql.strip()
            return run

        return put
