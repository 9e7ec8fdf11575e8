"""Registry of runnable queries and, where SQL can say it, the same query as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name with its SQL twin."""

    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def r6(x, name: str) -> Column:
    """A double rounded to six places, so that summation order does not show."""
    x = x if isinstance(x, Column) else F.col(x)
    return (F.round(x.cast("double"), 6) + F.lit(0.0)).alias(name)


def s6(expr: str, name: str) -> str:
    """The SQL twin of :func:`r6`."""
    return f"round(cast({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def r9(x, name: str) -> Column:
    """Nine places: for products of short decimals, which would sit on a sixth-place tie."""
    x = x if isinstance(x, Column) else F.col(x)
    return (F.round(x.cast("double"), 9) + F.lit(0.0)).alias(name)


def s9(expr: str, name: str) -> str:
    return f"round(cast({expr} AS DOUBLE), 9) + 0.0 AS {name}"


def wilson_sql(k: str, n: str, z: str = "1.96") -> dict[str, str]:
    """SQL text of the Wilson interval (n > 0)."""
    p, N, Z = f"(({k})::DOUBLE/({n})::DOUBLE)", f"({n})::DOUBLE", f"{z}::DOUBLE"
    den = f"(1.0::DOUBLE + {Z}*{Z}/{N})"
    center = f"(({p} + {Z}*{Z}/(2.0*{N}))/{den})"
    margin = f"({Z}*sqrt({p}*(1.0::DOUBLE-{p})/{N} + {Z}*{Z}/(4.0*{N}*{N}))/{den})"
    return {
        "rate": f"CASE WHEN ({n})=0 THEN 0.0::DOUBLE ELSE {p} END",
        "lower": f"CASE WHEN ({n})=0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {center}-{margin})) END",
        "upper": f"CASE WHEN ({n})=0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {center}+{margin})) END",
    }
