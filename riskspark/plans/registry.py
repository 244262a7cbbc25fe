"""Registry of named queries: a Spark callable plus its DuckDB twin.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver tables.  Outputs are normalised the same way on both sides:
integers as BIGINT and floating values rounded to 6 decimals, so results
can be compared by value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB twin (None for
    operators checked by property tests only)."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from riskspark.session import ship_package

            ship_package(spark)  # workers import riskspark (UDFs, stream state)
            return tidy(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def tidy(df: DataFrame) -> DataFrame:
    """Cast small integers to bigint, round floating columns to 6 places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round6(c.cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def round6(c):
    """Round a double to 6 places exactly like ``round(x, 6)`` in DuckDB:
    scale, round half away from zero, unscale (all in IEEE doubles)."""
    return F.round(c * F.lit(1e6)) / F.lit(1e6)


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"
