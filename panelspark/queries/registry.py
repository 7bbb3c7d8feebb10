"""Registry of the queries on fixture panels and of their equals in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.plans import panels as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PLACES = 6


def _round(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles to fixed places, negative zero to zero, dates as ISO text, so that two engines agree on what is the same."""
    kinds = {"double": lambda c: F.round(c, places) + F.lit(0.0), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = "", places: int = PLACES, dates: str = ""):
    """Registers a query; ``sql`` is its oracle, whose ``doubles`` are rounded and ``dates`` written as the query's are."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, d: _round(f(spark, d), places)
        if sql:
            fixed = ", ".join([f"round({c}, {places}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()])
            ORACLE[f.__name__] = f"SELECT * REPLACE ({fixed}) FROM ({sql})" if fixed else sql
        return f

    return register


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(P.SQL[n] for n in names)
