"""Collects the registered queries and, where there is one, their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources.given import GivenLedger

Build = Callable[[GivenLedger], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query built on the given ledger."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(GivenLedger(configure(spark), folder))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def load() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        change_queries, import_queries, ledger_queries, model_queries, mutation_queries,
        series_queries, stream_queries,
    )
