"""Market impact models. Each builds struct(price, impact_bps, slippage_usd, qty, confidence, reason)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelab.functions.numeric import clamp, col, is_finite

FIELDS = ("price", "impact_bps", "slippage_usd", "qty", "confidence")


def _result(price, bps, slip, qty, conf, reason) -> Column:
    return F.struct(*[v.alias(n) for n, v in zip((*FIELDS, "reason"), (price, bps, slip, qty, conf, reason))])


def _none(reason) -> Column:
    zero = F.lit(0.0)
    return _result(zero, zero, zero, zero, zero, reason)


def _sign(is_buy) -> Column:
    return F.when(col(is_buy), 1.0).otherwise(-1.0)


def _flat(o, bps, conf: float) -> Column:
    price = col(o["price"]) * (1.0 + _sign(o["is_buy"]) * bps / 10000.0)
    return _result(price, bps, col(o["qty"]) * col(o["price"]) * bps / 10000.0, col(o["qty"]), F.lit(conf), F.lit(None).cast("string"))


def book_walk(o: dict) -> Column:
    """Fill the order from valid levels: VWAP, impact against the reference price, fillable size."""
    qty, ref = col(o["qty"]), col(o["price"])
    good = F.filter(
        col(o["levels"]),
        lambda x: is_finite(x["price"]) & (x["price"] > 0) & is_finite(x["qty"]) & (x["qty"] > 0),
    )
    zero = F.lit(0.0)
    start = F.struct(qty.alias("left"), zero.alias("got"), zero.alias("paid"), F.lit(0).alias("used"))

    def step(a, x):
        take = F.when(a["left"] > 0, F.least(a["left"], x["qty"])).otherwise(0.0)
        return F.struct(
            (a["left"] - take).alias("left"), (a["got"] + take).alias("got"),
            (a["paid"] + take * x["price"]).alias("paid"), (a["used"] + F.when(a["left"] > 0, 1).otherwise(0)).alias("used"),
        )

    def done(a):
        mean = a["paid"] / a["got"]
        raw = F.when(col(o["is_buy"]), (mean / ref - 1.0) * 10000.0).otherwise((1.0 - mean / ref) * 10000.0)
        bps = F.greatest(raw, zero)
        conf = clamp(clamp(a["got"] / qty, 0, 1) * (0.75 + 0.05 * F.least(a["used"], F.lit(5))), 0, 1)
        short = F.when(a["left"] > 1e-12, F.lit("insufficient depth"))
        hit = _result(mean, bps, a["got"] * ref * bps / 10000.0, a["got"], conf, short)
        return F.when(a["got"] > 0, hit).otherwise(_none(F.lit("no valid levels")))

    return F.aggregate(good, start, step, done)


def square_root(o: dict, eta: float = 0.72, daily_volume: float = 18000.0) -> Column:
    """eta * volatility * sqrt(size / daily volume)."""
    vol = col(o["volatility"])
    if not (eta >= 0 and daily_volume > 0):
        return _none(F.lit("eta or daily volume unusable"))
    hit = _flat(o, eta * vol * F.sqrt(col(o["qty"]) / daily_volume), 0.72)
    return F.when(is_finite(vol) & (vol > 0), hit).otherwise(_none(F.lit("volatility missing")))


def almgren_lite(o: dict, temporary: float = 0.018, permanent: float = 0.012, horizon_ms: int = 750) -> Column:
    """volatility * sqrt(size) * (temporary * sqrt(model horizon / order horizon) + permanent)."""
    vol, hor = col(o["volatility"]), col(o["horizon_ms"])
    if not (horizon_ms > 0 and temporary >= 0 and permanent >= 0):
        return _none(F.lit("model parameters unusable"))
    bps = vol * F.sqrt(col(o["qty"])) * (temporary * F.sqrt(float(horizon_ms) / hor.cast("double")) + permanent)
    return (
        F.when(~(is_finite(vol) & (vol > 0)), _none(F.lit("volatility missing")))
        .when(hor.isNull() | (hor <= 0), _none(F.lit("horizon missing")))
        .otherwise(_flat(o, bps, 0.68))
    )


MODELS: dict[str, Callable[[dict], Column]] = {
    "Book-walk": book_walk, "Square-root": square_root, "Almgren-lite": almgren_lite,
}


def register(name: str, build: Callable[[dict], Column]) -> None:
    """Add an impact model; it takes the order's column names and returns the estimate struct."""
    MODELS[name] = build


def estimate(model: str, order: dict) -> Column:
    """Guarded estimate: an unusable size or reference price gives a reason instead of a value."""
    qty, ref = col(order["qty"]), col(order["price"])
    return (
        F.when(~is_finite(qty) | (qty <= 0), _none(F.lit("size must be positive")))
        .when(~is_finite(ref) | (ref <= 0), _none(F.lit("reference price must be positive")))
        .otherwise(MODELS[model](order))
    )
