"""Lab over recorded routes: rule sets compared on all runs, on held-out runs and under changed parameters.

A rule takes a route when its net edge reaches the rule's threshold, with at most the rule's size;
the route's result then shrinks with the size. All rules or swept points, of which there is a fixed
number, are columns over the same pass of the routes, which are not copied for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.operators.ordered import range_cuts
from tapelab.operators.risk import Point, backtest_blocks, lab_score, narrowed, run_distribution
from tapelab.plans.sweep import SLIPPAGES, THRESHOLDS
from tapelab.session import stage


@dataclass(frozen=True)
class Rule:
    name: str
    min_bps: float
    max_size: float


def _sized(pnl: str, size: str, limit: float) -> Column:
    """The result at no more than ``limit``; integers stay integers."""
    cut = F.col(pnl) * F.lit(limit) / F.col(size)
    return F.when(F.col(size) > limit, F.round(cut).cast("bigint")).otherwise(F.col(pnl))


def points(rules: list[Rule], pnl: str, net_bps: str, size: str) -> list[Point]:
    """A route under every rule: whether it is taken, and the result at the rule's size."""
    return [Point({"rule": r.name}, _sized(pnl, size, r.max_size), F.col(net_bps) >= r.min_bps, F.col(net_bps)) for r in rules]


def presets(routes: DataFrame, rules: list[Point], of: list[str], run: str, order: list[str]) -> DataFrame:
    """Result block and lab score of every rule, its distribution over the runs, and which rule is best.

    ``rules`` come from :func:`points` and read the columns ``of``. Equal scores go to the larger name.
    """
    routes = narrowed(routes, run, *order, *of)
    cuts = range_cuts(routes, order)
    whole = backtest_blocks(routes, rules, [], order, cuts=cuts).withColumn("lab_score", lab_score("pnl", "max_drawdown", "win_rate", "profit_factor", "ci95"))
    runs = stage(backtest_blocks(routes, rules, [run], order, cuts=cuts))  # a row per rule and run, read four times
    spread = run_distribution(runs, ["rule"]).withColumnRenamed("mean_pnl", "run_mean_pnl")
    out = stage(whole.join(spread, "rule"))  # a row per rule
    best = out.agg(F.max_by("rule", F.struct("lab_score", "rule")).alias("_best"))
    return out.join(F.broadcast(best)).withColumn("best", F.col("rule") == F.col("_best")).drop("_best")


def holdout(routes: DataFrame, rules: list[Point], of: list[str], run: str, order: list[str], champion: str) -> DataFrame:
    """Distribution of every rule over held-out runs, and how the frozen ``champion`` stands against the others.

    ``routes`` hold the held-out runs only. ``winner`` has the largest median, of equal ones the larger
    name; ``champion_gap`` is the champion's median minus the best of the others.
    """
    runs = stage(backtest_blocks(narrowed(routes, run, *order, *of), rules, [run], order))
    out = stage(run_distribution(runs, ["rule"]))
    mine = F.col("rule") == champion
    top = out.agg(
        F.max_by("rule", F.struct("median_pnl", "rule")).alias("winner"),
        (F.max(F.when(mine, F.col("median_pnl"))) - F.coalesce(F.max(F.when(~mine, F.col("median_pnl"))), F.lit(0))).alias("champion_gap"))
    return out.join(F.broadcast(top)).withColumn("champion_wins", F.col("winner") == champion)


def sensitivity_blocks(routes: DataFrame, order: list[str], pnl: str, capital: str, net_bps: str, threshold: float) -> DataFrame:
    """The whole result block at every point of the threshold and slippage sweeps, and the change of its P&L.

    The threshold sweep moves the least net edge; the slippage sweep charges the multiplier times
    the capital unit, also off the net edge, at the unchanged threshold. ``change`` is relative to
    the first point of the same sweep (0 where that is nothing).
    """
    p, cap, bps = F.col(pnl), F.col(capital), F.col(net_bps)
    swept = [Point({"parameter": "threshold", "multiplier": m}, p, bps >= threshold * m, bps) for m in THRESHOLDS]
    swept += [Point({"parameter": "slippage", "multiplier": m}, p - F.round(cap * m).cast("bigint"), bps - m >= threshold, bps - m) for m in SLIPPAGES]
    out = stage(backtest_blocks(narrowed(routes, *order, pnl, capital, net_bps), swept, [], order))
    first = out.groupBy("parameter").agg(F.min_by("pnl", "multiplier").cast("double").alias("_first"))
    change = F.when(F.abs("_first") > 1e-9, (F.col("pnl") - F.col("_first")) / F.col("_first")).otherwise(0.0)
    return out.join(F.broadcast(first), "parameter").withColumn("change", change).drop("_first")  # two rows
