"""Named queries: a Spark build and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Build], Build]:
        def keep(build: Build) -> Build:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = Query(build, sql)
            return build

        return keep
