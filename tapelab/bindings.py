"""The given tables seen as market data: quotes, trades, ledgers, shards, venues.

Prices are integer ticks, sizes integer lots and fees parts per million before they become
doubles, so every engine computes the same value. ``*_SQL`` hold the same bindings as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.config import CostModel, venue_table
from tapelab.functions.numeric import micros

# Venue fee (ppm of notional), withdrawal (BTC), reliability.
VENUE_BIND = {
    "click": (0.00003, 0.0001, 0.97), "error": (0.0001, 0.0001, 0.90),
    "purchase": (0.00005, 0.0001, 0.96), "signup": (0.0002, 0.0001, 0.95),
    "view": (0.00002, 0.0001, 0.98),
}
USD_BIND = ("error", "purchase")
MODEL = CostModel(
    max_btc=1.5, min_utility_usd=0.001, min_net_bps=0.2, slippage_bps=2.0, latency_bps=0.02,
    withdrawal_bps=0.1, usdt_premium_bps=0.3, stale_ms=10_800_000,
)
STALE_US = 10_800_000_000
TRADE_TIES = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]
TRADE_ORDER = ["t", "seq", *TRADE_TIES]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venues(spark: SparkSession) -> DataFrame:
    return venue_table(spark, VENUE_BIND, USD_BIND)


def quotes(spark: SparkSession, sf_dir: str, levels: bool = False) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = 10000 + F.round(F.col("value") * 100).cast("bigint") % 11
    half = 2 + F.col("user_id") % 5
    df = e.select(
        F.col("event_type").alias("venue"),
        F.concat(F.lit("P"), (F.col("user_id") % 3).cast("string")).alias("pair"),
        micros("ts").alias("t"),
        F.col("event_id").alias("seq"),
        (base - half).alias("bid_tick"), (base + half).alias("ask_tick"),
        (k % 20).alias("bid_lot"), (k * 7 % 20).alias("ask_lot"),
        (F.col("event_id") * 37 % 6000).alias("latency_ms"),
    )
    df = df.withColumns({
        "bid": F.col("bid_tick") / 100.0, "ask": F.col("ask_tick") / 100.0,
        "bid_qty": F.col("bid_lot") / 10.0, "ask_qty": F.col("ask_lot") / 10.0,
    })
    if levels:
        def side(tick, lot, sign, step):
            return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(
                ((F.col(tick) + i * 3 * sign) / 100.0).alias("price"),
                ((F.col(lot) + i * step) % 20 / 10.0).alias("qty")))

        df = df.withColumns({"bids": side("bid_tick", "bid_lot", -1, 5), "asks": side("ask_tick", "ask_lot", 1, 7)})
    return df


QUOTES_SQL = """
quotes AS (
  SELECT *, bid_tick / 100.0::DOUBLE AS bid, ask_tick / 100.0::DOUBLE AS ask,
         bid_lot / 10.0::DOUBLE AS bid_qty, ask_lot / 10.0::DOUBLE AS ask_qty
  FROM (
    SELECT event_type AS venue, concat('P', cast(user_id % 3 AS varchar)) AS pair, epoch_us(ts) AS t,
           event_id AS seq,
           10000 + cast(round(value*100) AS bigint) % 11 - (2 + user_id % 5) AS bid_tick,
           10000 + cast(round(value*100) AS bigint) % 11 + (2 + user_id % 5) AS ask_tick,
           cast(json_extract_string(props, '$.k') AS bigint) % 20 AS bid_lot,
           cast(json_extract_string(props, '$.k') AS bigint) * 7 % 20 AS ask_lot,
           event_id * 37 % 6000 AS latency_ms
    FROM events)),
venues(venue, fee, withdrawal_btc, reliability, usd_lane) AS (VALUES
  ('click', 0.00003::DOUBLE, 0.0001::DOUBLE, 0.97::DOUBLE, false),
  ('error', 0.0001, 0.0001, 0.90, true), ('purchase', 0.00005, 0.0001, 0.96, true),
  ('signup', 0.0002, 0.0001, 0.95, false), ('view', 0.00002, 0.0001, 0.98, false))"""

# one row per (quote, level): lv 0 is the best level
LEVELS_SQL = """
bid_levels AS (SELECT seq, i AS lv, (bid_tick - i*3)/100.0::DOUBLE AS price,
                      ((bid_lot + i*5) % 20)/10.0::DOUBLE AS qty FROM quotes, range(6) r(i)),
ask_levels AS (SELECT seq, i AS lv, (ask_tick + i*3)/100.0::DOUBLE AS price,
                      ((ask_lot + i*7) % 20)/10.0::DOUBLE AS qty FROM quotes, range(6) r(i))"""

_LAST = "last_value(CASE WHEN venue='{v}' THEN {{'venue': venue, 't': t, 'seq': seq, 'bid': bid, 'ask': ask, 'bid_qty': bid_qty, 'ask_qty': ask_qty, 'latency_ms': latency_ms}} END IGNORE NULLS) OVER w"


def asof_sql(by_pair: bool = True, stale_us: int | None = STALE_US) -> str:
    """CTEs ``latest`` (event x venue entries) and ``best`` (event with buy and sell entries)."""
    part = "PARTITION BY pair" if by_pair else ""
    items = ", ".join(_LAST.format(v=v) for v in sorted(VENUE_BIND))
    cond = f"AND a.t - a.q.t <= {stale_us}" if stale_us is not None else ""
    return f"""
latest AS (
  SELECT venue, pair, t, seq, bid, ask, bid_qty, ask_qty, latency_ms, unnest([{items}]) AS q
  FROM quotes WINDOW w AS ({part} ORDER BY t, seq)),
fresh AS (SELECT * FROM latest a WHERE q IS NOT NULL {cond}),
buys AS (SELECT seq, first(q ORDER BY q.ask, q.venue) AS buy FROM fresh GROUP BY seq),
sells AS (SELECT f.seq, first(q ORDER BY q.bid DESC, q.venue) AS sell
          FROM fresh f JOIN buys b ON f.seq = b.seq WHERE f.q.venue <> b.buy.venue GROUP BY f.seq),
best AS (SELECT qu.*, b.buy, s.sell FROM quotes qu JOIN buys b ON qu.seq=b.seq LEFT JOIN sells s ON qu.seq=s.seq)"""


def trade_values() -> dict[str, Column]:
    """What follows from the columns of ``TRADE_ORDER``: money in 1e-4 USD (``pnl``) and cents (``capital``), size and latency."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    edge = F.round(F.col("l_discount") * 100).cast("bigint") - F.round(F.col("l_tax") * 100).cast("bigint") - 2
    return {"capital": cents, "pnl": cents * edge, "qty": F.col("l_quantity"), "latency_ms": (F.col("seq") * 7 + F.col("l_linenumber") * 131) % 6000}


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed trades: money in 1e-4 USD (``pnl``) and cents (``capital``), both integers."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("buy_venue"),
        F.concat(F.lit("S"), (F.col("l_partkey") % 5).cast("string")).alias("sell_venue"),
        micros("l_shipdate").alias("t"), F.col("l_orderkey").alias("seq"), *TRADE_TIES)
    return rows.where("buy_venue <> sell_venue").withColumns({
        **trade_values(), "partial": F.col("l_returnflag") == "R", "route": F.concat_ws("->", "buy_venue", "sell_venue")})


TRADES_SQL = """
trades AS (
  SELECT *, concat(buy_venue, '->', sell_venue) AS route FROM (
    SELECT concat('S', cast(l_suppkey % 5 AS varchar)) AS buy_venue,
           concat('S', cast(l_partkey % 5 AS varchar)) AS sell_venue,
           epoch_us(l_shipdate) AS t, l_orderkey AS seq, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
           cast(round(l_extendedprice*100) AS bigint) AS capital,
           cast(round(l_extendedprice*100) AS bigint) * (cast(round(l_discount*100) AS bigint) - cast(round(l_tax*100) AS bigint) - 2) AS pnl,
           l_quantity AS qty, (l_orderkey*7 + l_linenumber*131) % 6000 AS latency_ms, l_returnflag = 'R' AS partial
    FROM lineitem) WHERE buy_venue <> sell_venue)"""
TRADE_ORDER_SQL = "t, seq, " + ", ".join(TRADE_TIES)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-chained ledger events; amounts are integer cents."""
    from tapelab.operators.ordered import ranked

    o = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("L"), (F.col("o_custkey") % 50).cast("string")).alias("ledger"),
        micros("o_orderdate").alias("t"), F.col("o_orderkey"),
        F.when(F.col("o_orderstatus") == "P", "rebalance").otherwise("fill").alias("kind"),
        F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("o_orderpriority").alias("venue"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("notional"),
    )
    o = ranked(o, ["ledger"], ["t", "o_orderkey"]).withColumn("sequence", F.col("rank") + 1)
    text = F.concat_ws("|", "ledger", F.col("sequence").cast("string"), "kind", "side", F.col("notional").cast("string"))
    return o.withColumns({
        "id": F.concat(F.lit("e"), F.col("o_orderkey").cast("string")),
        "fee": F.floor(F.col("notional") / 1000).cast("bigint"), "text": text, "hash": F.sha2(text, 256),
    }).drop("rank", "n")


LEDGER_SQL = """
ledger AS (
  SELECT *, concat_ws('|', ledger, cast(sequence AS varchar), kind, side, cast(notional AS varchar)) AS text,
         sha256(concat_ws('|', ledger, cast(sequence AS varchar), kind, side, cast(notional AS varchar))) AS hash
  FROM (
    SELECT concat('L', cast(o_custkey % 50 AS varchar)) AS ledger, epoch_us(o_orderdate) AS t, o_orderkey,
           CASE WHEN o_orderstatus='P' THEN 'rebalance' ELSE 'fill' END AS kind,
           CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o_orderpriority AS venue,
           cast(round(o_totalprice*100) AS bigint) AS notional,
           row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS sequence,
           concat('e', cast(o_orderkey AS varchar)) AS id,
           cast(round(o_totalprice*100) AS bigint) // 1000 AS fee
    FROM orders))"""


def shard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of monthly shards: shard, venue, pair, t and the counted flags."""
    return read(spark, sf_dir, "orders").select(
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM").alias("shard"),
        F.col("o_orderpriority").alias("venue"),
        F.concat(F.lit("P"), (F.col("o_custkey") % 3).cast("string")).alias("pair"),
        micros("o_orderdate").alias("t"), F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").alias("snapshot"), (F.col("o_orderkey") % 211 == 0).alias("gap"),
        (F.col("o_orderkey") % 13 == 0).alias("rest"), (F.col("o_orderkey") % 401 == 0).alias("reconnected"),
        F.round(F.col("o_totalprice")).cast("bigint").alias("bytes"),
    )


SHARDS_SQL = """
shard_events AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS shard, o_orderpriority AS venue,
         concat('P', cast(o_custkey % 3 AS varchar)) AS pair, epoch_us(o_orderdate) AS t, o_orderkey AS seq,
         o_orderstatus='F' AS snapshot, o_orderkey % 211 = 0 AS gap, o_orderkey % 13 = 0 AS rest,
         o_orderkey % 401 = 0 AS reconnected, cast(round(o_totalprice) AS bigint) AS bytes
  FROM orders)"""
