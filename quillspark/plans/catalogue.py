"""The catalogue of queries over the engine's operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import ingest_queries, job_queries, processing_queries, search_queries, state_queries

_PARTS = (search_queries, ingest_queries, state_queries, processing_queries, job_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.SQL.items()}
