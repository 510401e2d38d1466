"""Registration of queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import col, is_numeric
from riskframe.plans.roles import with_roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None, roles: Sequence[str] = (), extra: dict[str, str] | None = None):
    """Register a query under ``key``; ``sql`` gives the same rows in plain SQL."""

    def wrap(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_roles(sql, *roles, extra=extra)
        return fn

    return wrap


# Two engines add floating point numbers in different orders, so the last
# digits differ. Computed doubles are compared in single precision, which no
# decimal rounding tie can upset.


def near(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c), c.cast("float").cast("double") + F.lit(0.0))


def near_sql(expression: str) -> str:
    return f"(CAST(CAST({expression} AS FLOAT) AS DOUBLE) + 0.0::DOUBLE)"


def tidy(df: DataFrame, exact: Sequence[str] = ()) -> DataFrame:
    """Single precision for every floating column but the ``exact`` ones."""
    return df.select(
        *[
            near(col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in exact
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def tidy_all(df: DataFrame, key: str) -> DataFrame:
    """Every numeric column but the key as a single-precision double."""
    return df.select(
        *[
            near(col(f.name)).alias(f.name) if is_numeric(f.dataType) and f.name != key else col(f.name)
            for f in df.schema.fields
        ]
    )
