"""Register of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``, with the SQL of its expected result."""

    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def rounded(value: Column, places: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(value, places) + F.lit(0.0)
