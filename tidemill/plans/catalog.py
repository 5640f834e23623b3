"""Named queries, each with the equivalent SQL for an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = run
        if oracle:
            ORACLES[key] = oracle
        return fn

    return register
