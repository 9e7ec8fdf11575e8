"""Sensitivity of recorded routes to thresholds and slippage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Multipliers of the swept parameters.
THRESHOLDS = (0.25, 0.5, 1.0, 1.5, 2.0)
SLIPPAGES = (0.0, 0.5, 1.0, 2.0, 4.0)


def sensitivity(routes: DataFrame, pnl: str, capital: str, threshold: float) -> DataFrame:
    """Trades, P&L and win rate at every point of both sweeps, from one pass over the routes.

    A route is taken when its result per unit of capital reaches the threshold. The slippage sweep
    charges the multiplier times the capital unit at the unchanged threshold.
    """
    p, cap = F.col(pnl), F.col(capital)
    points = []
    for m in THRESHOLDS:
        points.append(F.when(p >= cap * threshold * m, F.struct(F.lit("threshold").alias("parameter"), F.lit(m).alias("multiplier"), p.alias("p"))))
    for m in SLIPPAGES:
        left = p - F.round(cap * m).cast("bigint")
        points.append(F.when(left >= cap * threshold, F.struct(F.lit("slippage").alias("parameter"), F.lit(m).alias("multiplier"), left.alias("p"))))
    rows = routes.select(F.inline(F.array_compact(F.array(*points))))
    return rows.groupBy("parameter", "multiplier").agg(
        F.count("*").alias("trades"), F.sum("p").alias("pnl"), (F.count_if(F.col("p") > 0) / F.count("*")).alias("win_rate"))


def elasticity(points: DataFrame) -> DataFrame:
    """Relative change of the P&L from the lowest to the highest threshold."""
    def at(m):
        return F.max(F.when((F.col("parameter") == "threshold") & (F.col("multiplier") == m), F.col("pnl"))).cast("double")

    lo, hi = at(THRESHOLDS[0]), at(THRESHOLDS[-1])
    return points.agg(F.when(F.abs(lo) > 1e-9, (hi - lo) / lo).otherwise(0.0).alias("elasticity"))
