"""The queries over the given tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows if there is one."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, so that engines that add up in another order agree."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def single(df: DataFrame) -> DataFrame:
    """Doubles to single precision: for prices, which as quotients of cents are often halfway between decimals."""
    return df.select(*[F.col(c).cast("float").cast("double").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Query]:
    from . import landing, modelling, preparing, scoring  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
