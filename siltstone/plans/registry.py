"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from siltstone.model.frames import Frames
from siltstone.plans.prelude import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of Frames under its name, with the SQL that gives the same rows, if SQL can."""

    def register(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Frames(spark, folder))
        if sql:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return register
