"""Named queries: a DataFrame function over the given tables and, where SQL can say the
same, the statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowplace.session import suited

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, d: str) -> DataFrame:
            return build(suited(spark), d)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add
