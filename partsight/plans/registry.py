"""``@query`` registers a function of (spark, sf_dir) under its key, with the DuckDB text when the
operator can be written in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partsight.sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(domain)`` as a query; ``oracle`` is its DuckDB twin."""

    def register(fn: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Domain(spark, sf_dir))

        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
