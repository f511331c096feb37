"""All queries of the library outside the optional subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import oracles, problems, queries as library

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return library.QUERIES | problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | problems.SQL
