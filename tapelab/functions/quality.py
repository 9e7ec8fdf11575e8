"""Quote validity, identity and book checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelab.functions.numeric import col, is_finite

DEPTH = 10  # visible levels that count as depth
BOOK_DEPTH = 50  # levels kept per side of a rebuilt book
PRICE_SCALE = 100000000.0


def depth(levels, fallback) -> Column:
    """Visible size: positive finite sizes of the first ten levels, else the BBO size, else 0."""
    sizes = F.transform(F.slice(col(levels), 1, DEPTH), lambda x: x["qty"])
    good = F.filter(sizes, lambda q: (q > 0) & is_finite(q))
    total = F.aggregate(good, F.lit(0.0), lambda a, q: a + q)
    fb = F.when(is_finite(fallback) & (col(fallback) > 0), col(fallback)).otherwise(0.0)
    return F.when(total > 0, total).otherwise(fb)


def valid_bbo(venue="venue", bid="bid", ask="ask") -> Column:
    """Simple validity: identified, finite, positive and not crossed."""
    return (
        (F.coalesce(col(venue), F.lit("")) != "")
        & is_finite(bid) & is_finite(ask)
        & (col(bid) > 0) & (col(ask) > 0) & (col(bid) < col(ask))
    )


def valid_quote(bid_depth, ask_depth, age_ms, stale_ms: int) -> Column:
    """Full validity: simple validity, depth on both sides and age within ``stale_ms``."""
    return valid_bbo() & (col(bid_depth) > 0) & (col(ask_depth) > 0) & (col(age_ms) <= stale_ms)


def quote_cause() -> Column:
    """First failing check of a quote, or 'valid' (fixed cause names)."""
    blank = (F.trim(F.coalesce(F.col("venue"), F.lit(""))) == "") | (
        F.trim(F.coalesce(F.col("pair"), F.lit(""))) == ""
    )
    return (
        F.when(blank, "identidad_vacia")
        .when(~is_finite("bid") | ~is_finite("ask"), "precio_no_finito")
        .when((F.col("bid") <= 0) | (F.col("ask") <= 0) | (F.col("bid") >= F.col("ask")), "bbo_invalido")
        .when(
            ~is_finite("bid_qty") | ~is_finite("ask_qty") | (F.col("bid_qty") < 0) | (F.col("ask_qty") < 0),
            "cantidad_invalida",
        )
        .otherwise("valid")
    )


def price_key(price) -> Column:
    """Price as a scaled integer, the key of a book level."""
    return F.round(col(price) * PRICE_SCALE).cast("bigint")


def level_violations(bids="bids", asks="asks") -> Column:
    """Names of the level rules a message breaks (empty array when it is clean)."""

    def bad(levels):
        return F.exists(
            col(levels),
            lambda x: ~is_finite(x["price"]) | ~is_finite(x["qty"]) | (x["price"] <= 0) | (x["qty"] < 0),
        )

    def unsorted(levels, descending):
        prices = F.transform(col(levels), lambda x: x["price"])
        nxt = F.slice(prices, F.lit(2), F.greatest(F.size(prices) - 1, F.lit(0)))
        pairs = F.zip_with(prices, nxt, lambda a, b: (a < b) if descending else (a > b))
        return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))

    return F.array_compact(
        F.array(
            F.when((F.size(col(bids)) > BOOK_DEPTH) | (F.size(col(asks)) > BOOK_DEPTH), F.lit("too_deep")),
            F.when(bad(bids) | bad(asks), F.lit("bad_level")),
            F.when(unsorted(bids, True), F.lit("bids_unsorted")),
            F.when(unsorted(asks, False), F.lit("asks_unsorted")),
        )
    )


def normal_pair(pair) -> Column:
    """'btc-usdt' -> 'BTC/USD'; a pair that does not end in USD(T) is only upper-cased."""
    compact = F.regexp_replace(F.upper(F.trim(col(pair))), "[/-]", "")
    base = F.regexp_replace(compact, "USDT?$", "")
    return F.when(compact.rlike("USDT?$"), F.concat(base, F.lit("/USD"))).otherwise(F.upper(col(pair)))


def lane(usd_lane) -> Column:
    return F.when(col(usd_lane), "USD").otherwise("USDT")


def route(buy, sell) -> Column:
    return F.concat_ws("->", col(buy), col(sell))


def route_pair(buy, sell, pair) -> Column:
    return F.concat_ws(":", route(buy, sell), col(pair))


def market(venue, pair) -> Column:
    return F.concat_ws(":", col(venue), col(pair))


def checksum_digits(text) -> Column:
    """Digits of a price or size without the point and leading zeros; NULL for other text."""
    compact = F.regexp_replace(text, r"\.", "")
    stripped = F.regexp_replace(compact, "^0+", "")
    return F.when(
        compact.rlike("^[0-9]+$"), F.when(stripped == "", F.lit("0")).otherwise(stripped)
    )


def book_checksum(bids="bids", asks="asks") -> Column:
    """CRC-32 over the digits of the ten best asks (rising) then the ten best bids (falling).

    Levels carry text fields ``price_text`` and ``qty_text`` and are already in book order.
    """

    def text(levels):
        return F.array_join(
            F.transform(
                F.slice(col(levels), 1, DEPTH),
                lambda x: F.concat(checksum_digits(x["price_text"]), checksum_digits(x["qty_text"])),
            ),
            "",
        )

    return F.crc32(F.concat(text(asks), text(bids)).cast("binary"))


def checksum_status(stated, bids="bids", asks="asks") -> Column:
    """Status of a book against the CRC-32 that its message states; NULL where none is stated.

    A book that fails counts as lost until the next snapshot.
    """
    same = book_checksum(bids, asks) == col(stated)
    return F.when(col(stated).isNotNull(), F.when(same, "checksum_crc32_ok").otherwise("checksum_crc32_fallido_requiere_snapshot"))


def latency_state(latency, stale_ms: int) -> Column:
    return (
        F.when(col(latency) == 0, "esperando mercado")
        .when(col(latency) > stale_ms * 0.75, "latencia alta")
        .otherwise("estable")
    )


def region_hint(venue, latency) -> Column:
    """Where to place a replica (fixed texts)."""
    return (
        F.when(col(latency) > 900.0, "probar replica mas cercana")
        .when(col(venue).isin("OKX", "Bybit"), "sin/hkg si domina el flujo")
        .otherwise("iad/us-east")
    )
