"""The library's registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewake.plans import execution, extra, logs, market, more, research, scalar, streams

Query = Callable[[SparkSession, str], DataFrame]
_ALL = {**scalar.QUERIES, **market.QUERIES, **execution.QUERIES, **research.QUERIES, **streams.QUERIES, **more.QUERIES, **extra.QUERIES, **logs.QUERIES}


def queries() -> dict[str, Query]:
    """Query name to a function of (spark, sf_dir)."""
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
