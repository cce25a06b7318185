"""Named queries over the given tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def named(name: str, sql: str | None = None):
    def keep(function):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return keep


def load_all() -> None:
    from caseloom.catalog import (  # noqa: F401
        cluster_queries, graph_queries, intake_queries, kpi_queries, model_queries, stream_queries, text_queries,
        vector_queries)
