"""Risk and performance measures of executed trades.

Money may be integer (scaled) or double; ratios do not depend on the scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.functions.numeric import clamp, ratio
from tapelab.operators.ordered import Cuts, bracketed_percentiles, brackets, drawdowns, ranked, rank_percentiles, running_sum, _same
from tapelab.session import stage


def trade_ratios(pnl: str = "pnl", capital: str = "capital", min_utility: float = 0.0) -> dict[str, Column]:
    """Aggregates for ``agg``: Sharpe, Sortino, Kelly, win probability and shares."""
    p = F.col(pnl)
    ret = F.when(F.col(capital) > 0, p.cast("double") / F.col(capital).cast("double"))
    n, nr = F.count("*"), F.count(ret)
    mean, sd = F.avg(ret), F.stddev_samp(ret)
    down = F.sqrt(F.avg(F.when(ret < 0, ret * ret).when(ret.isNotNull(), 0.0)))
    wins = F.count_if(p > 0)
    w = wins / n
    edge = F.avg(F.when(p > 0, p)).cast("double") / F.avg(F.when(p <= 0, -p)).cast("double")
    avg_loss = F.avg(F.when(p <= 0, -p))
    kelly = (
        F.when(n == 0, 0.0).when(wins == 0, 0.0).when(wins == n, 1.0).when(avg_loss <= 0, 1.0)
        .otherwise(clamp(w - (1.0 - w) / edge, 0, 1))
    )
    return {
        "trades": n,
        "total_pnl": F.coalesce(F.sum(pnl), F.lit(0)),
        "sharpe": F.when((nr < 2) | (sd == 0), 0.0).otherwise(mean / sd),
        "sortino": F.when((nr < 2) | (down == 0), 0.0).otherwise(mean / down),
        "kelly": kelly,
        "win_probability": (1.0 + wins) / (2.0 + n),
        "win_rate": ratio(wins, n),
        "captured": ratio(F.count_if(p >= min_utility), n),
    }


def risk_summary(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in trade_ratios(**kw).items()])


@dataclass(frozen=True)
class Point:
    """One way of reading a route: fixed ``labels``, its result, whether it is taken, and its net edge."""

    labels: dict
    pnl: Column
    accepted: Column
    net_bps: Column


def backtest_block(
    runs: DataFrame, keys: list[str], order: list[str], pnl: str, accepted: str, net_bps: str, parts: int | None = None
) -> DataFrame:
    """Result block per run: routes, trades, P&L, win rate, drawdown, quantiles, profit factor.

    ``runs`` holds every evaluated route with a boolean ``accepted``.
    """
    runs = narrowed(runs, *keys, *order, pnl, accepted, net_bps)
    return backtest_blocks(runs, [Point({}, F.col(pnl), F.col(accepted), F.col(net_bps))], keys, order, parts)


def narrowed(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns, worked out once: the passes and points of :func:`backtest_blocks` would each do it again."""
    return stage(rows.select(*dict.fromkeys(columns)))


def backtest_blocks(
    routes: DataFrame, points: list[Point], keys: list[str], order: list[str], parts: int | None = None, cuts: Cuts | None = None
) -> DataFrame:
    """:func:`backtest_block` per run and point of ``routes`` that are :func:`narrowed`. A route is sorted once for all points.

    Only the narrow passes that count see a row per route and point that takes it.
    """
    qs = {"p50": 0.5, "p95": 0.95}
    taken = F.array_compact(F.array(*[
        F.when(x.accepted, F.struct(F.lit(i).alias("point"), x.pnl.alias("_p"), x.net_bps.alias("_b"))) for i, x in enumerate(points)]))
    won = routes.select(*keys, F.inline(taken))
    p = F.col("_p")
    n = F.count("*")
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0)), F.sum(F.when(p < 0, -p).otherwise(0))
    sd = F.when(n < 2, 0.0).otherwise(F.stddev_samp(p))
    base = stage(won.groupBy(*keys, "point").agg(
        n.alias("trades"), ratio(F.count_if(p > 0), n).alias("win_rate"), F.avg("_b").alias("mean_net_bps"),
        F.avg(p).alias("mean_pnl"), sd.alias("sd_pnl"),
        F.when(n > 1, 1.96 * sd / F.sqrt(n.cast("double"))).otherwise(0.0).alias("ci95"),
        F.when(loss > 0, gain.cast("double") / loss.cast("double")).when(gain > 0, gain.cast("double")).otherwise(0.0).alias("profit_factor"),
        *[x.alias(k) for k, x in brackets(p, qs).items()]))
    some = F.lit(False)
    for x in points:
        some = some | F.coalesce(x.accepted, F.lit(False))
    dd = drawdowns(routes.where(some), keys, order, [F.when(x.accepted, x.pnl) for x in points], parts, cuts)
    pct = bracketed_percentiles(won, [*keys, "point"], "_p", base, qs, parts)
    labels = list(points[0].labels)
    every = F.inline(F.array(*[F.struct(F.lit(i).alias("point"), *[F.lit(y).alias(k) for k, y in x.labels.items()]) for i, x in enumerate(points)]))
    out = routes.groupBy(*keys).agg(F.count("*").alias("routes")).where("routes > 0").select(*keys, "routes", every)
    for part in (base.drop("_n", "_at"), dd, pct):
        out = out.join(part, [*keys, "point"], "left")
    return out.select(*labels, *[c for c in out.columns if c not in (*labels, "point")]).na.fill(0)


def run_distribution(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Summary over many runs: median, mean, p05/p95, interval of the mean, positive runs.

    Input: one row per run with pnl, max_drawdown and trades.
    """
    n = F.count("*")
    base = runs.groupBy(*keys).agg(
        n.alias("runs"), F.avg("pnl").alias("mean_pnl"),
        F.when(n > 1, 1.96 * F.stddev_samp("pnl") / F.sqrt(n.cast("double"))).otherwise(0.0).alias("ci95_mean"),
        F.count_if(F.col("pnl") > 0).alias("positive_runs"),
    )
    pct = rank_percentiles(runs, keys, "pnl", {"median_pnl": 0.5, "p05_pnl": 0.05, "p95_pnl": 0.95})
    dd = rank_percentiles(runs, keys, "max_drawdown", {"median_drawdown": 0.5})
    tr = rank_percentiles(runs, keys, "trades", {"median_trades": 0.5})
    out = base
    for part in (pct, dd, tr):
        out = _same(out, part, keys) if keys else out.join(F.broadcast(part))
    return out


def lab_score(pnl, max_drawdown, win_rate, profit_factor, ci95) -> Column:
    c = F.col
    return c(pnl) - c(max_drawdown) * 0.55 + c(win_rate) * 120.0 + F.least(c(profit_factor), F.lit(25.0)) * 4.0 - c(ci95)


def chunk_pnl(df: DataFrame, keys: list[str], order: list[str], value: str, chunks: int = 8, parts: int | None = None) -> DataFrame:
    """Sums over at most ``chunks`` equal consecutive windows of every key."""
    rows = ranked(df, keys, order, parts)
    k = F.least(F.col("n"), F.lit(chunks))
    width = F.ceil(F.col("n") / k)
    win = F.least(F.floor(F.col("rank") / width), k - 1).cast("int")
    # windows without a row (possible when the width rounds up) count as zero
    out = rows.groupBy(*keys, win.alias("window")).agg(F.sum(value).alias("pnl"), F.max("n").alias("_n"))
    full = df.groupBy(*keys).agg(F.count("*").alias("_t"))
    full = full.select(*keys, F.explode(F.sequence(F.lit(0), F.least(F.col("_t"), F.lit(chunks)).cast("int") - 1)).alias("window"))
    return full.join(out, [*keys, "window"], "left").select(*keys, "window", F.coalesce("pnl", F.lit(0)).alias("pnl"))


def stability(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Stability 1 - sd / (|mean| + sd) over window results, and how many windows lost."""
    mean, sd = F.avg("pnl").cast("double"), F.stddev_pop("pnl")
    flat = F.when(mean >= 0, 1.0).otherwise(0.0)
    return windows.groupBy(*keys).agg(
        F.when(F.max("pnl") == F.min("pnl"), flat).otherwise(clamp(1.0 - sd / (F.abs(mean) + sd), 0, 1)).alias("stability"),
        F.count_if(F.col("pnl") < 0).alias("negative_windows"),
    )


def cumulative_pnl(df: DataFrame, keys: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    return running_sum(df, keys, order, {"cumulative": value}, parts)


def latest_summary(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Totals of the audit store in one row."""
    return df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(value), F.lit(0)).alias("total_pnl"),
        ratio(F.count_if(F.col(value) > 0), F.count("*")).alias("win_rate"),
        F.max(order[0]).alias("latest"),
    )

