"""Canonical cost model, sizing, decision codes and opportunity rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelab.config import CostModel
from tapelab.functions.numeric import bps, col

COST_FIELDS = ("fee_buy", "fee_sell", "slippage", "withdrawal", "latency", "adverse", "total")


@dataclass(frozen=True)
class Leg:
    """One side of a route: price and the venue's configuration columns."""

    price: Column
    fee: Column
    withdrawal: Column
    usd_lane: Column
    levels: Column | None = None


def walk_slippage(qty, leg: Leg, is_buy: bool, model: CostModel) -> Column:
    """Cost of walking the book for ``qty`` against its first level.

    The remainder beyond the visible levels is priced at the first level; the result is kept in
    [0, qty * price * bps]. A leg without levels costs qty * fee * 1000 ("reference") or nothing.
    """
    qty = col(qty)
    fallback = qty * leg.fee * 1000.0 if model.slippage_fallback == "reference" else qty * 0.0
    if leg.levels is None:
        return fallback
    first = F.get(leg.levels, F.lit(0))["price"]
    start = F.struct(qty.alias("left"), F.lit(0.0).alias("cost"))

    def step(acc, lv):
        take = F.when(acc["left"] > 0, F.least(acc["left"], lv["qty"])).otherwise(0.0)
        return F.struct((acc["left"] - take).alias("left"), (acc["cost"] + take * lv["price"]).alias("cost"))

    end = F.aggregate(leg.levels, start, step)
    cost = end["cost"] + F.when(end["left"] > 0, end["left"] * first).otherwise(0.0)
    slip = (cost / qty - first) * qty
    slip = slip if is_buy else -slip
    cap = qty * first * model.slippage_bps / 10000.0
    walked = F.least(F.greatest(slip, F.lit(0.0)), cap)
    return F.when(F.coalesce(F.size(leg.levels), F.lit(0)) <= 0, fallback).otherwise(walked)


def cost_struct(qty, buy: Leg, sell: Leg, latency_ms, model: CostModel) -> Column:
    """All cost items of a route in USD as one struct; all zero when nothing is traded."""
    qty = col(qty)
    mid = (buy.price + sell.price) / 2.0
    volume = max(model.max_btc * 20.0, 1.0)
    fee_buy = qty * buy.price * buy.fee
    fee_sell = qty * sell.price * sell.fee
    slip = walk_slippage(qty, buy, True, model) + walk_slippage(qty, sell, False, model)
    out = qty * mid * model.withdrawal_bps / 10000.0 + mid * (buy.withdrawal + sell.withdrawal) * qty / volume
    premium = qty * mid * model.usdt_premium_bps / 10000.0
    out = F.when(buy.usd_lane != sell.usd_lane, out + premium).otherwise(out)
    late = (
        qty * mid * model.latency_bps
        * F.greatest(col(latency_ms), F.lit(1)).cast("double") / 10000.0 / 100.0
    )
    items = [fee_buy, fee_sell, slip, out, late, F.lit(0.0), fee_buy + fee_sell + slip + out + late]
    return F.struct(
        *[F.when(qty > 0, v).otherwise(0.0).alias(n) for n, v in zip(COST_FIELDS, items)]
    )


def scale_costs(costs, factor) -> Column:
    return F.struct(*[(col(costs)[n] * col(factor)).alias(n) for n in COST_FIELDS])


def size(*limits) -> Column:
    """Smallest limit, or 0 when any limit is not positive."""
    least = F.least(*[col(x) for x in limits])
    return F.when(least <= 0, 0.0).otherwise(least)


def affordable(usd, price, fee) -> Column:
    return col(usd) / (col(price) * (1.0 + col(fee)))


def decision(qty, utility, net_bps, latency_ms, buy_depth, model: CostModel) -> Column:
    """struct(code, threshold, actual): the first rule an opportunity fails (fixed codes)."""
    qty, utility, net_bps, lat = col(qty), col(utility), col(net_bps), col(latency_ms)
    thin, low_usd = qty <= 0, utility < model.min_utility_usd
    low_bps, stale = net_bps < model.min_net_bps, lat > model.stale_ms

    def chain(a, b, c, d, e):
        return F.when(thin, a).when(low_usd, b).when(low_bps, c).when(stale, d).otherwise(e)

    return F.struct(
        chain(
            F.lit("SKIP_THIN_OR_INVENTORY"), F.lit("SKIP_MIN_USD"), F.lit("SKIP_NET_BPS"),
            F.lit("SKIP_STALE"), F.lit("ACCEPT_EXECUTABLE"),
        ).alias("code"),
        chain(
            F.least(F.lit(model.max_btc), col(buy_depth)), F.lit(model.min_utility_usd),
            F.lit(model.min_net_bps), F.lit(float(model.stale_ms)), F.lit(model.min_net_bps),
        ).alias("threshold"),
        chain(qty, utility, net_bps, lat.cast("double"), net_bps).alias("actual"),
    )


def decision_text(code, threshold, actual) -> Column:
    return F.format_string("%s: %.2f against %.2f", col(code), col(actual), col(threshold))


def with_breaker(code, breaker) -> Column:
    """The loss breaker overrides an accepted route."""
    return F.when(col(breaker) & (col(code) == "ACCEPT_EXECUTABLE"), "SKIP_CIRCUIT_BREAKER").otherwise(col(code))


def opportunity(df, model: CostModel, buy_usd, sell_btc):
    """Add size, costs, net edge and the decision to rows of two-leg routes.

    Input columns: buy_*/sell_* of price, depth, fee, withdrawal, usd_lane, optional levels and
    latency. ``buy_usd`` / ``sell_btc`` are the balances that bound the size.
    """
    has = set(df.columns)
    buy = Leg(F.col("ask"), F.col("buy_fee"), F.col("buy_withdrawal"), F.col("buy_usd_lane"),
              F.col("buy_levels") if "buy_levels" in has else None)
    sell = Leg(F.col("bid"), F.col("sell_fee"), F.col("sell_withdrawal"), F.col("sell_usd_lane"),
               F.col("sell_levels") if "sell_levels" in has else None)
    out = df.withColumn(
        "qty",
        size(F.lit(model.max_btc), "buy_depth", "sell_depth", affordable(buy_usd, "ask", "buy_fee"), sell_btc),
    ).withColumn("costs", cost_struct("qty", buy, sell, "latency_ms", model))
    mid = (F.col("ask") + F.col("bid")) / 2.0
    out = out.withColumn("gross_usd", F.col("bid") - F.col("ask")).withColumn(
        "utility_usd", F.col("gross_usd") * F.col("qty") - F.col("costs.total")
    )
    out = out.withColumn("net_unit_usd", F.when(F.col("qty") > 0, F.col("utility_usd") / F.col("qty")).otherwise(0.0))
    out = out.withColumn("gross_bps", bps("gross_usd", mid)).withColumn("net_bps", bps("net_unit_usd", mid))
    d = decision("qty", "utility_usd", "net_bps", "latency_ms", "buy_depth", model)
    return (
        out.withColumn("decision", d)
        .withColumn("executable", F.col("decision.code") == "ACCEPT_EXECUTABLE")
        .withColumn("partial", (F.col("qty") > 0) & (F.col("qty") < model.max_btc * 0.999))
    )


def profit_breakdown() -> list[Column]:
    """Flat projection of an opportunity's economics."""
    c = F.col
    return [
        (c("gross_usd") * c("qty")).alias("gross_spread_usd"), c("gross_usd").alias("gross_unit_usd"),
        c("gross_bps"), c("costs.fee_buy").alias("buy_fee_usd"), c("costs.fee_sell").alias("sell_fee_usd"),
        c("costs.slippage").alias("slippage_usd"), c("costs.withdrawal").alias("rebalance_usd"),
        c("costs.latency").alias("latency_usd"), c("costs.adverse").alias("adverse_usd"),
        c("costs.total").alias("total_cost_usd"), c("utility_usd").alias("net_profit_usd"),
        c("net_unit_usd"), c("net_bps"), c("qty"), c("partial"),
    ]
