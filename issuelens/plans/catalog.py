"""Registered queries over the driver's tables, each with its DuckDB twin.

Every query reads whole tables from ``sf_dir`` (or data Spark derives from
them); nothing is subset, sampled or capped except where a limit is the
feature (top-k reports). Float outputs are rounded to 6 decimals on both
sides so that a different summation order cannot flip a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Tp

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query (and its oracle SQL, when SQL can express it)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every double/float column (output normalisation for the oracle).

    ``+ 0.0`` turns a rounded ``-0.0`` into ``0.0``, so float noise around an
    exact zero cannot flip a hash.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (Tp.DoubleType, Tp.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), decimals) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import the query modules so that they register themselves."""
    from issuelens.plans import (  # noqa: F401
        q_labelling, q_text, q_keywords, q_metrics, q_sampling, q_active, q_misc)
