"""Registry of named queries: each takes (spark, data folder) and returns a DataFrame; most have a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_scaled(c, digits: int = 6):
    """Round half away from zero on the scaled value, ``round(x * 10^d) / 10^d``.

    This is how SQL engines commonly round doubles; Spark's ``round`` instead rounds the shortest decimal
    string, and the two disagree on near-ties. Using one arithmetic rule keeps the comparison stable.
    """
    c = c.cast("double")
    p = float(10 ** digits)
    scaled = c * F.lit(p)
    r = F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(-F.floor(-scaled + 0.5)).cast("double") / F.lit(p)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) > F.lit(1e12)), c).otherwise(r)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns for engine-independent comparison (sums differ in the last bits)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_scaled(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every query module so that its ``@register`` calls run."""
    from . import (q_assembly, q_blend, q_folds, q_io, q_metrics, q_pooling, q_scoring,  # noqa: F401
                   q_text, q_tokens, q_weights)
