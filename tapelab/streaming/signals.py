"""Live rule signals as sliding windows (grid approximation of the exact batch signals)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.config import CostModel


def loss_breaker(trades: DataFrame, model: CostModel, ts: str = "ts", pnl: str = "pnl", limit: float | None = None, length: str | None = None, step: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """P&L of the last minutes on a grid and whether the loss limit is broken."""
    w = F.window(ts, length or f"{model.breaker_minutes} minutes", step)
    limit = model.breaker_loss_usd if limit is None else limit
    out = trades.withWatermark(ts, lateness).groupBy(w.alias("w")).agg(F.sum(pnl).alias("recent"))
    return out.select(F.col("w.end").alias("at"), "recent", (F.col("recent") < -limit).alias("breaker"))


def volatility(quotes: DataFrame, model: CostModel, ts: str = "ts", length: str | None = None, step: str = "5 seconds", lateness: str = "1 minute") -> DataFrame:
    """Range of the mid price in the last seconds per pair, and the conservative flag."""
    mid = (F.col("bid") + F.col("ask")) / 2.0
    w = F.window(ts, length or f"{model.volatility_seconds} seconds", step)
    out = quotes.withWatermark(ts, lateness).groupBy("pair", w.alias("w")).agg(F.min(mid).alias("lo"), F.max(mid).alias("hi"))
    rng = (F.col("hi") - F.col("lo")) / F.col("lo") * 10000.0
    return out.select("pair", F.col("w.end").alias("at"), rng.alias("range_bps"), (rng >= model.volatility_bps).alias("conservative"))
