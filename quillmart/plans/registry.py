"""The registered queries: name, Spark plan, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The module each query is in.
WHERE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation: double columns to so many digits, half to even, no negative zero. Operators themselves don't round."""
    return df.select(*((F.rint(F.col(f"`{c}`") * 10.0**digits) / 10.0**digits + 0.0).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def query(sql: str | None = None, doubles: str = "", digits: int = 6) -> Callable:
    """Register ``f(tables) -> DataFrame`` under its name.

    ``sql`` gives the same rows in DuckDB; ``doubles`` names its columns that are rounded as the query's are.
    """

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        WHERE[f.__name__] = f.__module__
        QUERIES[f.__name__] = lambda spark, path: rounded(f(Tables(spark, path)), digits)
        if sql is not None:
            swaps = ", ".join(f"round_even({c} * 1e{digits}, 0) / 1e{digits} + 0.0 AS {c}" for c in doubles.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({swaps}) FROM (\n{sql}\n)" if swaps else sql
        return f

    return keep
