"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from decidra.plans import engine_queries, unit_queries

FLAGSHIP = "decide_min_lexi"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**engine_queries.QUERIES, **unit_queries.QUERIES}
SQL: dict[str, str] = {**engine_queries.SQL, **unit_queries.SQL}
