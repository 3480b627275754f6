"""Collects named queries with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Register:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *views: str) -> None:
        """``views`` are common table expressions that the SQL refers to."""
        self.queries[name] = run
        if sql is not None:
            self.sql[name] = f"WITH {', '.join(views)} {sql}" if views else sql
