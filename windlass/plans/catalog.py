"""Named queries over the driver tables, and the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from windlass.plans import catalog_queries, evaluation_queries, head_queries, report_queries, rollup_queries, task_queries, timeline_queries

_ALL: dict = {**timeline_queries.QUERIES, **evaluation_queries.QUERIES, **catalog_queries.QUERIES, **report_queries.QUERIES, **rollup_queries.QUERIES, **head_queries.QUERIES, **task_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made[0] for name, made in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can't express have None and are tested on fixtures instead."""
    return {name: made[1] for name, made in _ALL.items() if made[1]}
