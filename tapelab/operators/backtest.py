"""Chronological split, rule backtests over a parameter grid, selection of a champion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab.config import GRID_IMPACTS, GRID_SCORES, GRID_THRESHOLDS, Split, Strategy
from tapelab.functions.numeric import clamp
from tapelab.functions.scoring import evaluation_score
from tapelab.operators.ordered import ranked

# Reject causes in the order of the tests.
CAUSES = ("sin_liquidez", "latencia", "umbral_neto", "score", "tamano_cero")
CHUNKS = 8


def split(df: DataFrame, order: list[str], train: int, calibrate: int, parts: int | None = None) -> DataFrame:
    """Add ``part`` A/B/C by exact chronological rank (n*train/100, n*calibrate/100, rest)."""
    rows = ranked(df, [], order, parts)
    a = F.floor(F.col("n") * train / 100)
    b = F.floor(F.col("n") * calibrate / 100)
    part = F.when(F.col("rank") < a, "A").when(F.col("rank") < a + b, "B").otherwise("C")
    # rank and size inside the part
    lo = F.when(F.col("part") == "A", 0).when(F.col("part") == "B", a).otherwise(a + b)
    hi = F.when(F.col("part") == "A", a).when(F.col("part") == "B", a + b).otherwise(F.col("n"))
    rows = rows.withColumn("part", part)
    return rows.withColumns({"rank": F.col("rank") - lo, "n": hi - lo})


def split_by(df: DataFrame, order: list[str], s: Split) -> DataFrame:
    return split(df, order, s.train, s.calibrate)


def gate(s: Strategy) -> dict[str, Column]:
    """Row-level outcome of one rule: net edge, reject cause (NULL if filled), size, result."""
    c = F.col
    net = c("gross_bps") - c("cost_bps") * s.impact
    score = evaluation_score(s.weights, net, "latency_ms", "available", "realized_bps", "gross_bps")
    if s.sizing == "kelly":
        size = F.least(F.lit(s.max_btc) * clamp(net / 20.0, 0.0, 0.5), c("available"))
    else:
        size = F.least(F.lit(s.max_btc), c("available"))
    cause = (
        F.when(c("available") <= 0, CAUSES[0]).when(c("latency_ms") > s.latency_ms, CAUSES[1])
        .when(net < s.threshold_bps, CAUSES[2]).when(score < s.score_floor, CAUSES[3])
        .when(size <= 0, CAUSES[4])
    )
    capital = c("ask") * size
    cost = capital * c("cost_bps") * s.impact / 10000.0
    trade = capital * (c("gross_bps") + c("realized_bps")) / 10000.0 - cost
    return {"net_bps": net, "score": score, "cause": cause, "size": size, "capital": capital, "cost": cost, "trade": trade}


@dataclass(frozen=True)
class Run:
    """A rule with one point of the grid; ``point`` is the grid position for ties."""

    strategy: Strategy
    point: int


def grid(strategies, thresholds=GRID_THRESHOLDS, impacts=GRID_IMPACTS, scores=GRID_SCORES) -> list[Run]:
    out = []
    for s in strategies:
        points = [(t, i, f) for t in thresholds for i in impacts for f in scores]
        out += [Run(replace(s, threshold_bps=t, impact=i, score_floor=f), k) for k, (t, i, f) in enumerate(points)]
    return out


_SUMS = ("orders", "filled", *[f"rej_{c}" for c in CAUSES], "unwinds", "turnover", "costs", "fill_qty", "btc", "capital",
         "gain", "loss", *[f"w{i}" for i in range(CHUNKS)])
_SCHEMA = (
    "strategy string, point int, threshold double, impact double, score_floor double, at bigint, "
    + ", ".join(f"{c} double" for c in _SUMS) + ", exposure double, s double, hi double, lo double, dd double"
)
_INPUT = ["rank", "n", "ask", "available", "latency_ms", "gross_bps", "cost_bps", "realized_bps"]


class _State:
    """Order-preserving summary of one rule over the rows of one task."""

    def __init__(self) -> None:
        self.sums = dict.fromkeys(_SUMS, 0.0)
        self.exposure = self.s = self.dd = 0.0
        self.hi, self.lo = -np.inf, np.inf

    def add(self, trade: np.ndarray) -> None:
        if not len(trade):
            return
        path = self.s + np.cumsum(trade)
        top = np.maximum(np.maximum.accumulate(path), self.hi)
        self.dd = max(self.dd, float((top - path).max()))
        self.hi, self.lo, self.s = float(top[-1]), min(self.lo, float(path.min())), float(path[-1])


def _fold(runs: list[Run]):
    """Task function: stream Arrow batches in order and emit one summary row per rule."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = [_State() for _ in runs]
        at = None
        for pdf in batches:
            if not len(pdf):
                continue
            at = int(pdf["rank"].iloc[0]) if at is None else at
            a = {c: pdf[c].to_numpy() for c in _INPUT}
            avail, lat, gross, real = a["available"], a["latency_ms"], a["gross_bps"], a["realized_bps"]
            chunks = np.minimum(a["n"], CHUNKS)
            width = -(-a["n"] // chunks)
            win = np.minimum(a["rank"] // width, chunks - 1)
            f2 = np.clip(1.0 - lat / 10000.0, 0.0, 1.0)
            f3 = np.clip(avail / 0.5, 0.0, 1.0)
            f4 = np.where(real >= 0.0, 1.0, 0.0)
            f5 = np.clip(np.abs(gross) / 20.0, 0.0, 1.0)
            for st, r in zip(states, runs):
                s = r.strategy
                net = gross - a["cost_bps"] * s.impact
                w = s.weights
                score = w[0] * np.clip(net / 10.0, -1.0, 1.0) + w[1] * f2 + w[2] * f3 + w[3] * f4 + w[4] * f5
                score = score / max(float(sum(w)), 1e-9)
                cap = s.max_btc * np.clip(net / 20.0, 0.0, 0.5) if s.sizing == "kelly" else s.max_btc
                size = np.minimum(cap, avail)
                tests = (avail <= 0, lat > s.latency_ms, net < s.threshold_bps, score < s.score_floor, size <= 0)
                cause = np.select(tests, range(len(CAUSES)), len(CAUSES))
                z = st.sums
                z["orders"] += len(net)
                for i, c in enumerate(CAUSES):
                    z[f"rej_{c}"] += int((cause == i).sum())
                ok = cause == len(CAUSES)
                if not ok.any():
                    continue
                size, capital = size[ok], a["ask"][ok] * size[ok]
                cost = capital * a["cost_bps"][ok] * s.impact / 10000.0
                trade = capital * (gross[ok] + real[ok]) / 10000.0 - cost
                z["filled"] += len(trade)
                z["turnover"] += float((2.0 * capital).sum())
                z["costs"] += float(cost.sum())
                z["fill_qty"] += float((size / max(s.max_btc, 1e-9)).sum())
                z["btc"] += float(size.sum())
                z["capital"] += float(capital.sum())
                z["gain"] += float(trade[trade >= 0].sum())
                z["loss"] -= float(trade[trade < 0].sum())
                z["unwinds"] += int((trade < 0).sum())
                for i, v in enumerate(np.bincount(win[ok], trade, CHUNKS)):
                    z[f"w{i}"] += float(v)
                st.exposure = max(st.exposure, float(capital.max()))
                st.add(trade)
        if at is not None:
            yield pd.DataFrame([
                {"strategy": r.strategy.name, "point": r.point, "threshold": r.strategy.threshold_bps,
                 "impact": r.strategy.impact, "score_floor": r.strategy.score_floor, "at": at, **st.sums,
                 "exposure": st.exposure, "s": st.s, "hi": st.hi if np.isfinite(st.hi) else 0.0,
                 "lo": st.lo if np.isfinite(st.lo) else 0.0, "dd": st.dd}
                for r, st in zip(runs, states)
            ])

    return work


def backtest(cands: DataFrame, runs: list[Run], parts: int | None = None) -> DataFrame:
    """Metrics of every rule and grid point over ``cands`` (with rank and n of their part).

    The candidates are range-partitioned by time once and read once; every task folds its rows, in
    order and batch by batch, into one row per rule. Those few rows are then combined in order, so
    neither the rules nor the grid multiply the shuffled data.
    """
    n = parts or int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cands.select(*_INPUT).repartitionByRange(n, "rank").sortWithinPartitions("rank")
    return combine(rows.mapInPandas(_fold(runs), _SCHEMA))


def combine(folded: DataFrame) -> DataFrame:
    """Merge the per-task summaries into the metrics of every rule."""
    keys = ["strategy", "point", "threshold", "impact", "score_floor"]
    before = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    f = folded.withColumn("_base", F.coalesce(F.sum("s").over(before), F.lit(0.0)))
    f = f.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_base") + F.col("hi")).over(before), F.lit(0.0)), F.lit(0.0)))
    deepest = F.greatest(F.col("dd"), F.col("_peak") - F.col("_base") - F.col("lo"), F.lit(0.0))
    m = f.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.max("exposure").alias("max_exposure_usd"), F.sum("s").alias("pnl_usd"),
        F.max(deepest).alias("max_drawdown_usd"),
    )
    c = F.col
    one = F.lit(1.0)
    counts = ("orders", "filled", "unwinds", *[f"rej_{x}" for x in CAUSES])
    m = m.withColumns({
        "fill_rate_orders": c("filled") / F.greatest(c("orders"), one),
        "fill_rate_quantity": c("fill_qty") / F.greatest(c("orders"), one),
        "unwind_rate": c("unwinds") / F.greatest(c("filled"), one),
        "pnl_per_btc_usd": c("pnl_usd") / F.greatest(c("btc"), F.lit(1e-9)),
        "pnl_per_capital": c("pnl_usd") / F.greatest(c("capital"), F.lit(1e-9)),
        "profit_factor": F.when(c("loss") > 0, c("gain") / c("loss")).when(c("gain") > 0, F.lit(float("inf"))).otherwise(0.0),
        "chunks": F.least(c("orders"), F.lit(float(CHUNKS))).cast("int"),
    }).withColumns({k: c(k).cast("bigint") for k in counts})
    wins = F.slice(F.array(*[c(f"w{i}") for i in range(CHUNKS)]), F.lit(1), F.greatest(c("chunks"), F.lit(1)))
    m = m.withColumn("pnl_windows", wins)
    k = F.size("pnl_windows").cast("double")
    m = m.withColumn("_mean", F.aggregate("pnl_windows", F.lit(0.0), lambda a, x: a + x) / k)
    m = m.withColumn("_sd", F.sqrt(F.aggregate("pnl_windows", F.lit(0.0), lambda a, x: a + (x - c("_mean")) * (x - c("_mean"))) / k))
    flat = F.when(c("_mean") >= 0, 1.0).otherwise(0.0)
    m = m.withColumns({
        "stability": F.when(c("_sd") == 0, flat).otherwise(clamp(1.0 - c("_sd") / (F.abs(c("_mean")) + c("_sd")), 0, 1)),
        "negative_windows": F.size(F.filter("pnl_windows", lambda x: x < 0)),
        "rejections": F.map_filter(
            F.create_map(*[v for x in sorted(CAUSES) for v in (F.lit(x), c(f"rej_{x}"))]), lambda _, v: v > 0),
        "objective": c("pnl_usd") - 0.35 * c("max_drawdown_usd"),
    })
    return m.drop("_mean", "_sd", "chunks", *[f"w{i}" for i in range(CHUNKS)])


def calibrated(metrics: DataFrame) -> DataFrame:
    """Best grid point per rule: objective, then profit factor, then the earlier point."""
    w = W.partitionBy("strategy").orderBy(F.col("objective").desc(), F.col("profit_factor").desc(), "point")
    return metrics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def champion(best: DataFrame, score: str = "objective", name: str = "strategy") -> DataFrame:
    """Rule with the highest finite score; ties go to the alphabetically first name."""
    ok = ~F.isnan(score) & (F.abs(score) < float("inf"))
    return best.where(ok).orderBy(F.col(score).desc(), name).limit(1)


def holdout_verdict(results: DataFrame, preregistered: str, name: str = "strategy", pnl: str = "pnl_usd") -> DataFrame:
    """Winner only if one rule leads beyond the tolerance; otherwise an inconclusive tie."""
    fin = ~F.isnan(pnl) & (F.abs(pnl) < float("inf"))
    ok = results.select(F.col(name).alias("name"), F.col(pnl).alias("p")).where(fin)
    top = ok.agg(F.max("p").alias("top"))
    lead = ok.join(F.broadcast(top), F.abs(F.col("top") - F.col("p")) <= F.greatest(F.abs("top") * 1e-9, F.lit(1e-9)))
    v = lead.agg(F.count("*").alias("leaders"), F.min("name").alias("name"))
    winner = (
        F.when(F.col("leaders") == 0, "sin_resultados_validos").when(F.col("leaders") > 1, "empate_inconcluso").otherwise(F.col("name"))
    )
    won = (F.col("leaders") == 1) & (F.col("name") == preregistered)
    text = (
        F.when(F.col("leaders") == 0, "sin_resultados_validos").when(F.col("leaders") > 1, "empate_inconcluso")
        .when(won, "campeon_supera_estrictamente").otherwise("otra_estrategia_supera")
    )
    return v.select(winner.alias("winner"), F.coalesce(won, F.lit(False)).alias("champion_won"), text.alias("conclusion"))


def strategy_funnel(cands: DataFrame, filled: int | Column) -> DataFrame:
    """Candidates, gross and net edges, fills and the share of net edges that were filled."""
    filled = F.lit(filled) if isinstance(filled, int) else filled
    net = F.count_if(F.col("gross_bps") - F.col("cost_bps") > 0)
    return cands.agg(
        F.count("*").alias("candidates"), F.count_if(F.col("gross_bps") > 0).alias("gross"), net.alias("net"),
    ).withColumn("filled", filled).withColumn("conversion", F.col("filled") / F.greatest(F.col("net"), F.lit(1)).cast("double"))
