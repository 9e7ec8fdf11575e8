"""Venue payloads (bronze rows: venue, local_t, payload) to canonical book messages.

Each venue is a small mapping from its message layout to common fields. New venues register a
mapping; nothing else changes. Rows of other channels drop out. Works on batch and streams.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.functions.numeric import is_finite
from tapelab.functions.quality import normal_pair

DEPTH = 10  # levels that the compared recorder keeps of a message
_depth: ContextVar[int | None] = ContextVar("depth", default=None)  # while a mapping is built
OUT = ["venue", "pair", "t", "exchange_ms", "kind", "sequence", "previous", "bids", "asks"]


def _at(path: str) -> Column:
    return F.get_json_object("payload", path)


def _double(text: Column) -> Column:
    return F.when(text.rlike(r"^[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"), text.cast("double"))


def _first(levels: Column) -> Column:
    return levels if _depth.get() is None else F.slice(levels, 1, _depth.get())


def pairs(path: str) -> Column:
    """Levels written as [price, size, ...] with numbers or texts, price > 0."""
    raw = _first(F.from_json(_at(path), "array<array<string>>"))
    lv = F.transform(raw, lambda x: F.struct(_double(F.get(x, F.lit(0))).alias("price"), _double(F.get(x, F.lit(1))).alias("qty")))
    return _usable(F.coalesce(lv, F.array().cast("array<struct<price:double,qty:double>>")))


def _usable(levels: Column) -> Column:
    return F.filter(levels, lambda x: is_finite(x["price"]) & is_finite(x["qty"]) & (x["price"] > 0))


def named(path: str, price: str, qty: str) -> Column:
    """Levels written as objects."""
    raw = _first(F.from_json(_at(path), f"array<struct<{price}:string,{qty}:string>>"))
    lv = F.transform(raw, lambda x: F.struct(_double(x[price]).alias("price"), _double(x[qty]).alias("qty")))
    return _usable(F.coalesce(lv, F.array().cast("array<struct<price:double,qty:double>>")))


def _updates(rows: Column, keep: Callable, price: Callable, qty: Callable) -> Column:
    return _usable(F.transform(_first(F.filter(rows, keep)), lambda x: F.struct(price(x).alias("price"), qty(x).alias("qty"))))


def _iso_ms(path: str) -> Column:
    return F.unix_millis(F.try_to_timestamp(_at(path)))


@dataclass(frozen=True)
class Mapping:
    """How one venue says: is this a book message, which pair, snapshot or delta, numbers, levels."""

    accept: Callable[[], Column]
    pair: Callable[[], Column]
    snapshot: Callable[[], Column]
    bids: Callable[[], Column]
    asks: Callable[[], Column]
    sequence: Callable[[], Column] = lambda: F.lit(None).cast("bigint")
    previous: Callable[[], Column] = lambda: F.lit(None).cast("bigint")
    event_ms: Callable[[], Column] = lambda: F.lit(None).cast("bigint")


def _long(path: str) -> Callable[[], Column]:
    return lambda: F.when(_at(path).rlike("^[0-9]+$"), _at(path).cast("bigint"))


def _text(path: str, default: str) -> Callable[[], Column]:
    return lambda: F.coalesce(_at(path), F.lit(default))


_COIN = "array<struct<type:string,product_id:string,updates:array<struct<side:string,price_level:string,price:string,new_quantity:string,quantity:string,product_id:string>>>>"


def _coin_side(sides: tuple) -> Callable[[], Column]:
    def build():
        rows = F.flatten(F.transform(F.from_json(_at("$.events"), _COIN), lambda e: e["updates"]))
        return _updates(
            rows, lambda u: u["side"].isin(*sides), lambda u: _double(F.coalesce(u["price_level"], u["price"])),
            lambda u: _double(F.coalesce(u["new_quantity"], u["quantity"])))

    return build


def _finex_rows() -> Column:
    many = F.from_json(_at("$[1]"), "array<array<string>>")
    one = F.array(F.from_json(_at("$[1]"), "array<string>"))
    snap = _at("$[1][0]") == "snapshot"
    # a snapshot marker comes first and is not a level
    return F.when(snap | _at("$[1][0]").startswith("["), F.from_json(F.regexp_replace(_at("$[1]"), r'^\["snapshot",?', "["), "array<array<string>>")).otherwise(F.coalesce(F.when(F.get(many, F.lit(0)).isNotNull(), many), one))


def _finex_side(bid: bool) -> Callable[[], Column]:
    def build():
        amount = lambda x: _double(F.get(x, F.lit(2)))
        gone = lambda x: F.get(x, F.lit(1)) == "0"
        return _updates(
            _finex_rows(), lambda x: ((amount(x) > 0) if bid else (amount(x) <= 0)) & ~gone(x),
            lambda x: _double(F.get(x, F.lit(0))), lambda x: F.abs(amount(x)))

    return build


_GEM = "array<struct<type:string,side:string,price:string,remaining:string>>"


def _gem_side(side: str) -> Callable[[], Column]:
    def build():
        rows = F.coalesce(F.from_json(_at("$.events"), _GEM), F.from_json("payload", _GEM))
        return _updates(rows, lambda x: x["side"] == side, lambda x: _double(x["price"]), lambda x: _double(x["remaining"]))

    return build


_no = lambda: F.lit(False)
# Message paths of the supported venues.
VENUES: dict[str, Mapping] = {
    "Binance": Mapping(
        lambda: F.coalesce(_at("$.b"), _at("$.bids")).isNotNull(), _text("$.s", "BTCUSDT"), lambda: _at("$.lastUpdateId").isNotNull(),
        lambda: F.when(_at("$.b").isNotNull(), pairs("$.b")).otherwise(pairs("$.bids")),
        lambda: F.when(_at("$.a").isNotNull(), pairs("$.a")).otherwise(pairs("$.asks")),
        _long("$.lastUpdateId"), event_ms=_long("$.E")),
    "OKX": Mapping(
        lambda: _at("$.arg.channel").startswith("books"), _text("$.arg.instId", "BTC-USDT"),
        lambda: (F.coalesce(_at("$.action"), F.lit("")) == "snapshot") | (_at("$.arg.channel") == "books5"),
        lambda: pairs("$.data[0].bids"), lambda: pairs("$.data[0].asks"), _long("$.data[0].seqId"), _long("$.data[0].prevSeqId"), _long("$.data[0].ts")),
    "Bybit": Mapping(
        lambda: _at("$.topic").startswith("orderbook."), lambda: F.element_at(F.split(_at("$.topic"), r"\."), -1), lambda: _at("$.type") == "snapshot",
        lambda: pairs("$.data.b"), lambda: pairs("$.data.a"), _long("$.data.seq"), event_ms=_long("$.ts")),
    "Kraken": Mapping(
        lambda: _at("$.channel") == "book", _text("$.data[0].symbol", "BTC/USD"),
        lambda: (F.coalesce(_at("$.data[0].type"), F.lit("")) == "snapshot") | (F.coalesce(_at("$.type"), F.lit("")) == "snapshot"),
        lambda: named("$.data[0].bids", "price", "qty"), lambda: named("$.data[0].asks", "price", "qty"), event_ms=lambda: _iso_ms("$.data[0].timestamp")),
    "Coinbase": Mapping(
        lambda: _at("$.channel").isin("level2", "l2_data"), _text("$.events[0].product_id", "BTC-USD"), lambda: F.exists(F.from_json(_at("$.events"), _COIN), lambda e: e["type"] == "snapshot"),
        _coin_side(("bid", "BUY", "buy")), _coin_side(("offer", "ask", "SELL", "sell")), _long("$.sequence_num"), event_ms=lambda: _iso_ms("$.timestamp")),
    "Bitfinex": Mapping(
        lambda: _at("$[1]").isNotNull() & (_at("$[1]") != "hb") & (_at("$[1]") != "[]"), lambda: F.lit("BTC/USD"), lambda: F.coalesce(_at("$[1][0]") == "snapshot", F.lit(False)),
        _finex_side(True), _finex_side(False)),
    "KuCoin": Mapping(
        lambda: _at("$.subject").isNotNull() & (F.coalesce(_at("$.type"), F.lit("")) != "welcome"), lambda: F.lit("BTC/USD"), lambda: _at("$.subject") == "trade.l2snapshot",
        lambda: pairs("$.data.bids"), lambda: pairs("$.data.asks"), _long("$.data.sequence"), event_ms=_long("$.data.timestamp")),
    "Gate.io": Mapping(
        lambda: _at("$.method") == "order_book.update", _text("$.params[2]", "BTC/USD"), _no,
        lambda: pairs("$.params[3].bids"), lambda: pairs("$.params[3].asks"), event_ms=_long("$.params[1]")),
    "Bitstamp": Mapping(
        lambda: _at("$.event").isNotNull() & (_at("$.event") != "bts:subscription_succeeded"), lambda: F.lit("BTC/USD"), _no,
        lambda: pairs("$.data.bids"), lambda: pairs("$.data.asks"), event_ms=_long("$.data.timestamp")),
    "Gemini": Mapping(
        lambda: F.lit(True), lambda: F.lit("BTC/USD"), _no, _gem_side("bid"), _gem_side("ask")),
}


def register(venue: str, mapping: Mapping) -> None:
    VENUES[venue] = mapping


def normalise(raw: DataFrame, venues: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """Canonical messages of all mapped venues, from one pass over the raw rows.

    Each row is parsed by the mapping of its own venue only. All levels of a message are kept, as
    books rebuilt from a tape need every update; ``depth`` cuts each side to its first levels, in
    the same way for every venue (DEPTH gives what the compared recorder keeps).
    """
    token = _depth.set(depth)
    try:
        return _normalise(raw, venues)
    finally:
        _depth.reset(token)


def _normalise(raw: DataFrame, venues: list[str] | None) -> DataFrame:
    names = venues or list(VENUES)
    message = F.lit(None)
    for name in reversed(names):
        m = VENUES[name]
        fields = F.struct(
            normal_pair(m.pair()).alias("pair"), m.event_ms().alias("exchange_ms"),
            F.when(F.coalesce(m.snapshot(), F.lit(False)), "snapshot").otherwise("delta").alias("kind"),
            m.sequence().alias("sequence"), m.previous().alias("previous"), m.bids().alias("bids"), m.asks().alias("asks"))
        hit = F.when(F.coalesce(m.accept(), F.lit(False)), fields)
        message = F.when(F.col("venue") == name, hit).otherwise(message)
    # a generator keeps the parsed message as one value instead of copying its text per column
    rows = raw.select("venue", F.col("local_t").alias("t"), F.inline(F.array_compact(F.array(message))))
    return rows.select(*OUT)
