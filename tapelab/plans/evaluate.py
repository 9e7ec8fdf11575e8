"""Walk-forward evaluation: split, calibrate on B, freeze, judge on C."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.config import STRATEGIES, CostModel, Split
from tapelab.operators.backtest import Run, backtest, calibrated, champion, grid, holdout_verdict, split_by, strategy_funnel
from tapelab.operators.funnel import candidates, quote_funnel
from tapelab.session import stage

MIN_EVENTS = 10


def candidate_parts(quotes: DataFrame, venues: DataFrame, model: CostModel, s: Split = Split(), by_pair: bool = True, parts: int | None = None) -> DataFrame:
    """Priced candidates with their part (A/B/C), rank and size; staged, as all steps read them."""
    c = candidates(quotes, venues, model, None, by=None if by_pair else [], parts=parts).where("sell_venue IS NOT NULL")
    c = stage(c.select("t", "seq", "buy_venue", "sell_venue", "ask", "bid", "available", "qty", "costs", "latency_ms", "gross_bps", "cost_bps", "realized_bps"))
    return split_by(c, ["t", "seq"], s)


def calibrate(parts: DataFrame, strategies=STRATEGIES) -> DataFrame:
    """Best grid point of every rule on part B."""
    return calibrated(backtest(parts.where("part = 'B'"), grid(strategies)))


def frozen(best: DataFrame, strategies=STRATEGIES) -> list[Run]:
    """Rules with their calibrated parameters; one row per rule comes to the driver."""
    chosen = {r["strategy"]: r for r in best.select("strategy", "point", "threshold", "impact", "score_floor").collect()}
    return [
        Run(replace(s, threshold_bps=r["threshold"], impact=r["impact"], score_floor=r["score_floor"]), r["point"])
        for s in strategies if (r := chosen.get(s.name)) is not None
    ]


def evaluate(quotes: DataFrame, venues: DataFrame, model: CostModel, s: Split = Split(), strategies=STRATEGIES, by_pair: bool = True) -> dict[str, DataFrame]:
    """All result tables: funnel, calibration, champion, holdout, verdict, strategy_funnel.

    The holdout is read only after the parameters are frozen on part B.
    """
    parts = stage(candidate_parts(quotes, venues, model, s, by_pair))
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    if sum(sizes.values()) < MIN_EVENTS or len(sizes) < 3:
        raise ValueError("at least 10 candidates and no empty part are needed")
    best = stage(calibrate(parts, strategies))
    chosen = champion(best)
    name = chosen.first()["strategy"]
    holdout = stage(backtest(parts.where("part = 'C'"), frozen(best, strategies)))
    filled = holdout.where(F.col("strategy") == name).agg(F.coalesce(F.max("filled"), F.lit(0))).first()[0]
    return {
        "funnel": quote_funnel(quotes, parts), "calibration": best, "champion": chosen, "holdout": holdout,
        "verdict": holdout_verdict(holdout, name), "strategy_funnel": strategy_funnel(parts.where("part = 'C'"), int(filled)),
    }
