"""State summaries: health checks, capital, run summary, replay summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.config import CostModel
from tapelab.functions.numeric import bps
from tapelab.sources.exports import table_fingerprint

# Statuses that mean a feed cannot be trusted.
BROKEN = ("gap_requiere_snapshot", "fuera_de_orden", "esperando_snapshot")


def health_checks(quotes: DataFrame, decisions: DataFrame, operations: DataFrame, model: CostModel, venues: DataFrame, now, stale: int) -> DataFrame:
    """Rows (check, ok, detail) over the current quotes and logs.

    ``quotes``: venue, t, rest, status; one row per market. ``decisions``: code. ``operations``: partial.
    """
    fresh = now - F.col("t") <= stale
    q = quotes.agg(
        F.count_distinct(F.when(fresh, F.col("venue"))).alias("fresh"), F.count_distinct(F.when(fresh & ~F.col("rest"), F.col("venue"))).alias("sockets"),
        F.count_if("rest").alias("rest_quotes"), F.count_if(fresh & F.col("status").isin(*BROKEN)).alias("broken"))
    d = decisions.agg(F.count_if(F.coalesce("code", F.lit("")) != "").alias("explained"))
    o = operations.agg(F.count("*").alias("operations"), F.count_if("partial").alias("partials"))
    v = venues.agg(F.count("*").alias("configured"))
    j = q.join(F.broadcast(d)).join(F.broadcast(o)).join(F.broadcast(v))  # one row each
    c = F.col
    costs_set = model.max_btc > 0 and model.min_utility_usd >= 0 and model.min_net_bps >= 0
    named = [
        ("feeds", c("sockets") >= 2, c("sockets")), ("snapshots", c("fresh") >= 2, c("fresh")), ("integrity", (c("broken") == 0) & (c("fresh") >= 2), c("broken")),
        ("costs", F.lit(costs_set) & (c("configured") > 0), c("configured")), ("rest_fallback", (c("rest_quotes") > 0) | (c("sockets") >= 2), c("rest_quotes")),
        ("decision_inspector", c("explained") > 0, c("explained")), ("partial_fill_evidence", c("partials") > 0, c("partials"))]
    return j.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), x.alias("detail")) for n, ok, x in named])))


def capital(balances: DataFrame, mark) -> DataFrame:
    """Capital now and at the start at one mark price, and the return in bps."""
    usd = F.sum(F.col("usd") + F.col("btc") * mark)
    start = F.sum(F.col("usd0") + F.col("btc0") * mark)
    return balances.agg(usd.alias("capital_usd"), start.alias("initial_usd")).withColumn("return_bps", bps(F.col("capital_usd") - F.col("initial_usd"), "initial_usd"))


def run_summary(opportunities: DataFrame, latency: DataFrame, operations: DataFrame) -> DataFrame:
    """Best route, best executable route, fastest and slowest venue, latest partial fill."""
    key = F.struct("net_bps", "route", "seq")
    best = opportunities.agg(
        F.max(key).alias("_best"), F.max(F.when(F.col("executable"), F.struct("utility_usd", "route", "seq"))).alias("_exec"))
    lat = latency.agg(F.min(F.struct("ewma", "venue")).alias("_lo"), F.max(F.struct("ewma", "venue")).alias("_hi"))
    part = operations.where("partial").agg(F.max(F.struct("t", "seq", "route")).alias("_p"))
    j = best.join(F.broadcast(lat)).join(F.broadcast(part))
    return j.select(
        F.col("_best.route").alias("best_route"), F.col("_exec.route").alias("best_executable"), F.col("_lo.venue").alias("fastest"),
        F.col("_hi.venue").alias("slowest"), F.col("_p.route").alias("latest_partial"))


def replay_summary(ticks: DataFrame, operations: DataFrame, pnl: str = "pnl") -> DataFrame:
    """Ticks, analysis cycles, operations, P&L and a fingerprint of the replayed input.

    ``ticks`` comes from the replay clock and has ``cycle``.
    """
    t = ticks.agg(F.count("*").alias("ticks"), F.count_distinct("cycle").alias("cycles"))
    o = operations.agg(F.count("*").alias("operations"), F.coalesce(F.sum(pnl), F.lit(0)).alias("pnl"))
    f = table_fingerprint(ticks.drop("cycle", "clock")).select("low", "high")
    return t.join(F.broadcast(o)).join(F.broadcast(f))
