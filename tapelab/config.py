"""Run parameters. They are small frozen values that turn into literals or tiny tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fee, withdrawal (BTC) and reliability of the known venues.
VENUES = {
    "Binance": (0.0010, 0.00010, 0.98),
    "Kraken": (0.0026, 0.00020, 0.97),
    "Coinbase": (0.0060, 0.00012, 0.96),
    "OKX": (0.0010, 0.00010, 0.96),
    "Bybit": (0.0010, 0.00010, 0.95),
    "Bitfinex": (0.0020, 0.00010, 0.95),
    "KuCoin": (0.0010, 0.00010, 0.94),
    "Gate.io": (0.0020, 0.00010, 0.93),
    "Bitstamp": (0.0025, 0.00010, 0.96),
    "Gemini": (0.0035, 0.00010, 0.97),
    "Jupiter": (0.0010, 0.0, 0.92),
    "Raydium": (0.0025, 0.0, 0.90),
}
# What an unknown venue gets, and the venues that quote in USD.
DEFAULT_VENUE = (0.0015, 0.00015, 0.90)
USD_VENUES = ("Coinbase", "Kraken")
# Default score weights (utility, freshness, size, reliability, z-score).
WEIGHTS = (0.40, 0.20, 0.20, 0.10, 0.10)


@dataclass(frozen=True)
class CostModel:
    """Costs, thresholds and risk limits that apply to every venue."""

    max_btc: float = 0.25
    min_utility_usd: float = 0.0
    min_net_bps: float = 0.5
    slippage_bps: float = 1.0
    latency_bps: float = 0.2
    withdrawal_bps: float = 0.5
    usdt_premium_bps: float = 0.0
    allow_cross_lane: bool = False
    stale_ms: int = 5000
    cooldown_ms: int = 1400
    shock_bps: float = 4.0
    breaker_loss_usd: float = 500.0
    breaker_minutes: int = 10
    volatility_bps: float = 50.0
    volatility_seconds: int = 30
    rebalance_trigger_pct: float = 35.0
    rebalance_transfer_pct: float = 50.0
    rebalance_cost_usd: float = 10.0
    slippage_fallback: str = "reference"  # or "zero": what a leg without levels costs


@dataclass(frozen=True)
class Split:
    """Chronological train / calibrate / holdout shares in percent."""

    train: int = 50
    calibrate: int = 20
    holdout: int = 30

    def __post_init__(self) -> None:
        if min(self.train, self.calibrate, self.holdout) <= 0:
            raise ValueError("every part of the split must be positive")
        if self.train + self.calibrate + self.holdout != 100:
            raise ValueError("the split must add up to 100 percent")


@dataclass(frozen=True)
class Strategy:
    """One trading rule; the calibrated fields are replaced by grid values."""

    name: str
    threshold_bps: float
    max_btc: float
    sizing: str = "available"  # available, fixed, kelly
    weights: tuple = WEIGHTS
    latency_ms: int = 5000
    impact: float = 1.0
    score_floor: float = 0.0


# The compared rules. The random-parameter rule takes its draws from the caller.
STRATEGIES = (
    Strategy("spread_neto_simple", 0.0, 0.25, weights=(1.0, 0.0, 0.0, 0.0, 0.0)),
    Strategy("preset_conservador", 2.0, 0.08, weights=(0.45, 0.25, 0.1, 0.1, 0.1)),
    Strategy("preset_balanceado", 0.65, 0.18),
    Strategy("tamano_fijo", 0.65, 0.10, sizing="fixed"),
    Strategy("kelly_fraccional", 0.65, 0.30, sizing="kelly"),
    Strategy("parametros_aleatorios", 1.3, 0.21, weights=(0.7, 0.1, 0.5, 0.3, 0.9)),
    Strategy("campeon_ga_congelado", 0.65, 0.18),
)
# The calibration grid.
GRID_THRESHOLDS = (0.0, 0.5, 1.0, 2.0, 4.0)
GRID_IMPACTS = (0.75, 1.0, 1.25, 1.5)
GRID_SCORES = (0.0, 0.25, 0.5)


def venue_table(spark: SparkSession, venues: dict | None = None, usd=USD_VENUES) -> DataFrame:
    """Venue configuration as a table: venue, fee, withdrawal_btc, reliability, usd_lane."""
    rows = ", ".join(
        f"('{n}', {f!r}D, {w!r}D, {r!r}D, {str(n in usd).lower()})" for n, (f, w, r) in (venues or VENUES).items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(venue, fee, withdrawal_btc, reliability, usd_lane)")
