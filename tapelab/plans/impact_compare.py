"""The same orders through every impact model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.config import CostModel
from tapelab.functions.impact import MODELS, estimate
from tapelab.operators.ordered import drawdown

BASE = "Book-walk"
ORDER = {"qty": "qty", "price": "price", "is_buy": "is_buy", "levels": "levels", "volatility": "volatility", "horizon_ms": "horizon_ms"}


def model_rows(orders: DataFrame, cfg: CostModel, models: list[str] | None = None) -> DataFrame:
    """One row per order and model with the estimate, the decision and the realised result.

    Input: t, seq, qty, price, is_buy, levels, volatility, horizon_ms, gross_bps, observed_bps.
    ``differs`` compares the decision with the base model's on the same order.
    """
    models = models or list(MODELS)
    keep = ["t", "seq", "price", "gross_bps", "observed_bps"]
    c = F.col

    def accept(e):
        edge = c("gross_bps") - e["impact_bps"]
        worth = edge * e["qty"] * c("price") / 10000.0 >= cfg.min_utility_usd
        return (e["qty"] > 0) & (edge >= cfg.min_net_bps) & worth

    df = orders.withColumn("_base", estimate(BASE, ORDER)).withColumn("_yes", accept(c("_base")))
    ests = F.array(*[
        F.struct(F.lit(m).alias("model"), (c("_base") if m == BASE else estimate(m, ORDER)).alias("e")) for m in models])
    df = df.select(*keep, "_yes", F.inline(ests)).withColumn("accepted", accept(c("e")))
    result = (c("gross_bps") - c("observed_bps")) * c("e.qty") * c("price") / 10000.0
    return df.select(
        *keep, "model", "e.impact_bps", c("e.qty").alias("fill_qty"), c("e.reason").alias("reason"), "accepted",
        (c("accepted") != c("_yes")).alias("differs"), F.when(c("accepted"), result).alias("result"))


def compare(orders: DataFrame, cfg: CostModel, models: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Per model: P&L at observed impact, fill rate, drawdown, error, bias, decisions unlike the base."""
    rows = model_rows(orders, cfg, models)
    c = F.col
    err = c("impact_bps") - c("observed_bps")
    w = rows.groupBy("model").agg(
        F.count("*").alias("orders"), F.count_if("accepted").alias("accepted_orders"), F.count_if("differs").alias("different"),
        (F.count_if("accepted") / F.count("*")).alias("fill_rate"), F.avg("impact_bps").alias("mean_impact_bps"),
        F.avg(F.abs(err)).alias("mae_bps"), F.avg(err).alias("bias_bps"),
        F.coalesce(F.avg(F.when(c("accepted"), c("fill_qty"))), F.lit(0.0)).alias("mean_qty"))
    dd = drawdown(rows.where("accepted"), ["model"], ["t", "seq"], "result", parts)
    return w.join(dd, "model", "left").na.fill(0, ["pnl", "max_drawdown"])


def answers(table: DataFrame) -> DataFrame:
    """Which model errs least and which underestimates the cost most."""
    return table.agg(
        F.min_by("model", F.struct("mae_bps", "model")).alias("least_error"),
        F.min_by("model", F.struct("bias_bps", "model")).alias("most_underestimating"))
