"""Scores, microstructure features and edge explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelab.config import WEIGHTS
from tapelab.functions.numeric import clamp, col, is_finite, sigmoid


def _weighted(weights: list[Column], features: list[Column]) -> Column:
    total = weights[0] * features[0]
    for w, f in zip(weights[1:], features[1:]):
        total = total + w * f
    return total


def _total(weights: list[Column]) -> Column:
    out = weights[0]
    for w in weights[1:]:
        out = out + w
    return out


def canonical_score(weights, utility, latency_ms, tolerance_ms, qty, max_qty, reliability, z) -> Column:
    """Five clamped features times normalised weights (an array column or a tuple)."""
    if isinstance(weights, (tuple, list)):
        raw = [F.lit(float(w)) for w in weights]
    else:
        raw = [F.get(col(weights), F.lit(i)) for i in range(5)]
    total = _total(raw)
    w = [F.when(total > 0, F.greatest(r, F.lit(0.0)) / total).otherwise(d) for r, d in zip(raw, WEIGHTS)]
    features = [
        clamp(col(utility) / 100.0, 0, 1),
        clamp(1.0 - col(latency_ms).cast("double") / F.greatest(col(tolerance_ms), F.lit(1)).cast("double"), 0, 1),
        clamp(col(qty) / F.greatest(col(max_qty), F.lit(1e-8)), 0, 1),
        clamp(reliability, 0, 1),
        clamp(col(z) / 3.0, 0, 1),
    ]
    return _weighted(w, features)


def evaluation_score(weights: tuple, net_bps, latency_ms, available, realized_bps, gross_bps) -> Column:
    """Score of the offline evaluation. It looks ahead: it uses the sign of the realised move."""
    total = F.greatest(F.lit(float(sum(weights))), F.lit(1e-9))
    features = [
        clamp(col(net_bps) / 10.0, -1, 1),
        clamp(1.0 - col(latency_ms) / 10000.0, 0, 1),
        clamp(col(available) / 0.5, 0, 1),
        F.when(col(realized_bps) >= 0, 1.0).otherwise(0.0),
        clamp(F.abs(col(gross_bps)) / 20.0, 0, 1),
    ]
    return _weighted([F.lit(float(w)) for w in weights], features) / total


def imbalance(bid, ask) -> Column:
    return (col(bid) - col(ask)) / F.greatest(col(bid) + col(ask), F.lit(1e-12))


def top_size(levels, n: int) -> Column:
    return F.aggregate(F.slice(col(levels), 1, n), F.lit(0.0), lambda a, x: a + x["qty"])


def features(df):
    """Microstructure features of each book; crossed or one-sided books are left out."""
    c = F.col
    df = df.where((c("ask") > c("bid")) & (c("bid_qty") > 0) & (c("ask_qty") > 0))
    df = df.withColumns({"bid_depth5": top_size("bids", 5), "ask_depth5": top_size("asks", 5)})
    mid = (c("bid") + c("ask")) / 2.0
    micro = (c("ask") * c("bid_qty") + c("bid") * c("ask_qty")) / (c("bid_qty") + c("ask_qty"))
    return df.withColumns({
        "mid": mid,
        "skew_bps": (micro / mid - 1.0) * 10000.0,
        "imbalance_l1": imbalance("bid_qty", "ask_qty"),
        "imbalance_l5": imbalance("bid_depth5", "ask_depth5"),
        "liquidity": c("bid_depth5") + c("ask_depth5"),
        "age_ms": c("latency_ms").cast("double"),
    })


def fill_label(first_markout, bid, ask) -> Column:
    """Proxy of a fill: the first markout does not lose more than half the spread."""
    return col(first_markout) >= -(col(ask) / col(bid) - 1.0) * 5000.0


def fill_probability(age="age_ms", asyn="async_ms", skew="skew_bps", l1="imbalance_l1", l5="imbalance_l5", liq="liquidity") -> Column:
    return sigmoid(
        -0.15 - col(age) / 500.0 - col(asyn) / 350.0 + 0.45 * col(skew) + 0.8 * col(l1) + 1.1 * col(l5)
        + 0.03 * F.log1p(col(liq))
    )


def second_leg_risk(age="age_ms", asyn="async_ms", l5="imbalance_l5", liq="liquidity") -> Column:
    return sigmoid(-2.2 + col(age) / 240.0 + col(asyn) / 130.0 - 0.55 * col(l5) - 0.08 * F.log1p(col(liq)))


def clean_weights(weights) -> Column:
    """Replace unusable weights by their defaults and normalise."""
    raw = [F.get(col(weights), F.lit(i)) for i in range(5)]
    fixed = [F.when(is_finite(r) & (r >= 0), r).otherwise(d) for r, d in zip(raw, WEIGHTS)]
    total = _total(fixed)
    return F.array(*[F.when(total > 0, f / total).otherwise(f) for f in fixed])


def route_confidence(history) -> Column:
    return F.when(col(history).isNull(), 0.58).otherwise(clamp(0.50 + col(history) * 0.08, 0.05, 0.98))


def explain_edge(df, max_btc: float, stale_ms: int, shock_bps: float, latency_bps: float):
    """Explain every decision row: feature values, contributions, survival, fill, expected value.

    Input: weights, utility_usd, latency_ms, qty, history (route reliability), z, cost_usd.
    """
    c = F.col
    stale = float(max(stale_ms, 1))
    late = c("latency_ms").cast("double") / stale
    df = df.withColumn("w", clean_weights("weights")).withColumns({
        "f_utility": F.greatest(F.tanh(c("utility_usd") / 25.0), F.lit(0.0)),
        "f_fresh": clamp(1.0 - late, 0, 1),
        "f_size": clamp(c("qty") / max(max_btc, 1e-8), 0, 1),
        "f_route": route_confidence("history"),
        "f_z": clamp(0.5 + F.tanh(c("z")) / 2.0, 0, 1),
    })
    names = ["f_utility", "f_fresh", "f_size", "f_route", "f_z"]
    score = _weighted([F.get("w", F.lit(i)) for i in range(5)], [c(n) for n in names])
    df = df.withColumns({
        "score": score,
        "survival": clamp(c("f_fresh") * 0.56 + c("f_route") * 0.24 + c("f_z") * 0.20, 0, 1),
        "fill": clamp(c("f_size") * 0.72 + c("f_route") * 0.18 + c("f_fresh") * 0.10, 0, 1),
    })
    parts = F.array(*[
        F.struct(F.lit(n[2:]).alias("name"), F.get("w", F.lit(i)).alias("weight"), c(n).alias("value"),
                 (F.get("w", F.lit(i)) * c(n)).alias("contribution"))
        for i, n in enumerate(names)
    ])
    return df.withColumns({
        "features": parts,
        "adverse_bps": (1.0 - c("survival")) * shock_bps + clamp(late, 0, 2) * latency_bps,
        "expected_usd": c("utility_usd") * c("survival") * c("fill") - c("cost_usd") * (1.0 - c("fill")) * 0.12,
        "confidence": clamp(c("score") * 0.55 + c("survival") * 0.25 + c("fill") * 0.20, 0, 1),
    })


def expected_utility(expected, buy_price, sell_price, qty, cost_total, cost_adverse) -> Column:
    """Recorded expectation, or spread minus costs (without adverse selection) when it is 0."""
    spread = (col(sell_price) - col(buy_price)) * col(qty)
    return F.when(F.abs(col(expected)) > 0, col(expected)).otherwise(
        spread - F.greatest(col(cost_total) - col(cost_adverse), F.lit(0.0))
    )
