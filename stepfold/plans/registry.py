"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r9(x: Column | str) -> Column:
    """Rounded to nine places, so that the order of additions does not show."""
    return F.round(F.col(x) if isinstance(x, str) else x, 9)


from . import contracts, delivery, legacy, measures, objects, poses, scores, steps, texts, verdicts, views  # noqa: E402, F401
