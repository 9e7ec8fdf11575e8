"""Where the gross edge of a trade goes: waterfall, break-even frontier, capacity curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Waterfall keys and size factors of the capacity curve.
ITEMS = ("grossSpread", "takerFees", "slippage", "marketImpact", "latency", "rebalance", "other", "net")
FACTORS = (0.10, 0.25, 0.50, 0.75, 1.00, 1.15, 1.30, 1.50)
EPS = 2.220446049250313e-16


def economics(df: DataFrame) -> DataFrame:
    """Non-negative cost groups per trade.

    Input: qty, buy_price, sell_price, net_usd, costs struct (fee_buy .. total).
    """
    c = F.col

    def pos(x):
        return F.greatest(x, F.lit(0.0))

    df = df.withColumns({
        "qty0": pos(c("qty")),
        "fees": pos(c("costs.fee_buy") + c("costs.fee_sell")), "slip": pos(c("costs.slippage")),
        "impact": pos(c("costs.adverse")), "late": pos(c("costs.latency")), "moved": pos(c("costs.withdrawal")),
    })
    df = df.withColumn("gross", pos((c("sell_price") - c("buy_price")) * c("qty0")))
    df = df.withColumn("known", c("fees") + c("slip") + c("impact") + c("late") + c("moved"))
    df = df.withColumn("other", pos(c("costs.total") - c("known")))
    return df.withColumns({
        "calculated": c("gross") - c("known") - c("other"),
        "notional": F.greatest(c("buy_price") * c("qty0"), F.lit(EPS)),
    })


def waterfall(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row per trade and item; costs are negative, ``reconciled`` is true within one cent."""
    c = F.col
    values = [c("gross"), -c("fees"), -c("slip"), -c("impact"), -c("late"), -c("moved"), -c("other"), c("net_usd")]
    items = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(k).alias("item"), v.alias("value_usd"))
        for i, (k, v) in enumerate(zip(ITEMS, values))
    ])
    ok = F.abs(c("calculated") - c("net_usd")) <= 0.01
    return economics(df).select(*ids, ok.alias("reconciled"), F.inline(items))


def break_even(df: DataFrame, ids: list[str], slippage_bps: float) -> DataFrame:
    """How much more cost each trade would bear before its edge is gone."""
    c = F.col
    room = F.greatest(c("net_usd"), F.lit(0.0))
    room_bps = room / c("notional") * 10000.0
    total = c("costs.total")
    return economics(df).select(
        *ids, c("notional"), (F.greatest(total, F.lit(0.0)) / c("notional") * 10000.0).alias("total_cost_bps"),
        c("gross").alias("max_total_cost_usd"), room.alias("headroom_usd"), room_bps.alias("headroom_bps"),
        F.when(total > 0, c("gross") / total).otherwise(0.0).alias("max_cost_multiplier"),
        (c("fees") / c("notional") * 10000.0 + room_bps).alias("fee_limit_bps"),
        (slippage_bps + room_bps).alias("slippage_limit_bps"),
    )


def capacity(df: DataFrame, ids: list[str], nested: bool = False) -> DataFrame:
    """Expected result at eight sizes: slippage and impact grow with the square of the size.

    One row per trade and size, or with ``nested`` one per trade with the array ``points``.
    """
    c = F.col
    df = economics(df).withColumn("linear", F.greatest(c("costs.total") - c("slip") - c("impact"), F.lit(0.0)))

    def point(f):
        pnl = c("gross") * f - c("linear") * f - (c("slip") + c("impact")) * f * f
        return F.struct(f.alias("factor"), (c("qty0") * f).alias("size"), pnl.alias("pnl_usd"), (f <= 1.0).alias("observed"))

    points = F.transform(F.array(*[F.lit(f) for f in FACTORS]), point)
    return df.select(*ids, points.alias("points")) if nested else df.select(*ids, F.inline(points))


def best_capacity(curve: DataFrame, ids: list[str]) -> DataFrame:
    """Best point per trade; the larger size wins a tie.

    ``curve`` as :func:`capacity` gives it. Nested points are compared inside their row, so one row per trade is sorted and shuffled.
    """
    if "points" in curve.columns:
        curve = curve.select(*ids, F.array_max(F.transform("points", lambda p: F.struct(p["pnl_usd"], p["factor"], p["size"]))).alias("_p"))
    else:
        curve = curve.select(*ids, F.struct("pnl_usd", "factor", "size").alias("_p"))
    return curve.groupBy(*ids).agg(F.max("_p").alias("_b")).select(*ids, "_b.factor", "_b.size", "_b.pnl_usd")
