"""Stage counts: how many quotes survive each test on the way to a tradable edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.config import DEFAULT_VENUE, CostModel
from tapelab.functions.costs import Leg, cost_struct
from tapelab.functions.numeric import bps, per_million, wilson
from tapelab.functions.quality import quote_cause
from tapelab.operators.asof import best_pair, latest_by_venue
from tapelab.session import small

PAYLOAD = ["bid", "ask", "bid_qty", "ask_qty", "latency_ms"]


def with_venue_config(df: DataFrame, venues: DataFrame, on: str, prefix: str = "") -> DataFrame:
    """Look up a venue's configuration; the table, one row per feed, is broadcast while it is small."""
    return join_venue_config(df, small(venues), on, prefix)


def join_venue_config(df: DataFrame, venues: DataFrame, on: str, prefix: str = "") -> DataFrame:
    """Look up fee, withdrawal, reliability and lane of ``on``; unknown venues get the defaults."""
    fee, wd, rel = DEFAULT_VENUE
    v = venues.select(
        F.col("venue").alias("_cv"), F.col("fee").alias(f"{prefix}fee"),
        F.col("withdrawal_btc").alias(f"{prefix}withdrawal"),
        F.col("reliability").alias(f"{prefix}reliability"), F.col("usd_lane").alias(f"{prefix}usd_lane"),
    )
    out = df.join(v, F.col(on) == F.col("_cv"), "left").drop("_cv")
    defaults = {"fee": fee, "withdrawal": wd, "reliability": rel, "usd_lane": False}
    return out.withColumns({prefix + k: F.coalesce(F.col(prefix + k), F.lit(d)) for k, d in defaults.items()})


def candidates(
    quotes: DataFrame, venues: DataFrame, model: CostModel, stale: int | None, by: list[str] | None = None,
    parts: int | None = None, names: list[str] | None = None,
) -> DataFrame:
    """One row per quote with the best cross-venue pair and its costs (sell_venue NULL if alone)."""
    df = best_pair(latest_by_venue(quotes, PAYLOAD, by=by, venues=names, parts=parts), stale)
    return price_candidates(df, venues, model)


def price_candidates(df: DataFrame, venues: DataFrame, model: CostModel) -> DataFrame:
    """Costs and edges of rows that hold ``buy`` and ``sell`` entries."""
    keep = [c for c in df.columns if c not in ("latest", "buy", "sell", "ask", "bid", "latency_ms", "ask_qty", "bid_qty")]
    df = df.select(
        *keep, F.col("bid").alias("quote_bid"), F.col("ask").alias("quote_ask"),
        F.col("buy.venue").alias("buy_venue"), F.col("sell.venue").alias("sell_venue"),
        F.col("buy.ask").alias("ask"), F.col("sell.bid").alias("bid"),
        F.greatest(F.least("buy.ask_qty", "sell.bid_qty"), F.lit(0.0)).alias("available"),
        F.greatest("buy.latency_ms", "sell.latency_ms").alias("latency_ms"),
    )
    df = with_venue_config(with_venue_config(df, venues, "buy_venue", "buy_"), venues, "sell_venue", "sell_")
    c = F.col
    df = df.withColumn("qty", F.least("available", F.lit(model.max_btc)))
    buy = Leg(c("ask"), c("buy_fee"), c("buy_withdrawal"), c("buy_usd_lane"))
    sell = Leg(c("bid"), c("sell_fee"), c("sell_withdrawal"), c("sell_usd_lane"))
    df = df.withColumn("costs", cost_struct("qty", buy, sell, "latency_ms", model))
    mid = (c("ask") + c("bid")) / 2.0
    return df.withColumns({
        "mid": mid,
        "gross_bps": (c("bid") - c("ask")) / mid * 10000.0,
        "cost_bps": bps("costs.total", c("ask") * c("qty")),
        "realized_bps": ((c("quote_bid") + c("quote_ask")) / 2.0 - mid) / mid * 10000.0,
    })


def stage_counts() -> dict[str, Column]:
    """Counts of the scan: a pair without traded size has unbounded cost, so it is never net."""
    pair = F.col("sell_venue").isNotNull()
    gross = pair & (F.col("gross_bps") > 0)
    net = gross & (F.col("ask") * F.col("qty") > 0) & (F.col("gross_bps") > F.col("cost_bps"))
    return {"comparable": pair, "gross": gross, "net": net, "liquid_net": net & (F.col("available") > 0)}


def scan_funnel(cands: DataFrame, keys: list[str] | None = None, raw: DataFrame | None = None) -> DataFrame:
    """Corpus scan: events, comparable, gross, net and liquid-net with Wilson bounds.

    Rates are per event of ``cands`` or, given ``raw`` (one row), per ``raw_events``: then events
    whose book is not valid count as well.
    """
    aggs = [F.count("*").alias("events")]
    aggs += [F.count_if(cond).alias(name) for name, cond in stage_counts().items()]
    out = cands.groupBy(*(keys or [])).agg(*aggs)
    base = "events"
    if raw is not None:
        out, base = out.join(F.broadcast(raw)), "raw_events"
    for name in ("gross", "net", "liquid_net"):
        w = wilson(name, base)
        out = out.withColumn(f"{name}_per_million", per_million(name, base))
        out = out.withColumn(f"{name}_lower_95", w["lower"]).withColumn(f"{name}_upper_95", w["upper"])
    return out


def scan_rollup(cands: DataFrame) -> DataFrame:
    """The scan counts per (venue, pair), per venue and in total from one pass."""
    aggs = [F.count("*").alias("events")] + [F.count_if(c).alias(n) for n, c in stage_counts().items()]
    return cands.rollup("venue", "pair").agg(*aggs)


def scan_rejects(books: DataFrame) -> DataFrame:
    """Events per cause that keeps them out of the scan (fixed cause names)."""
    cause = (
        F.when(F.col("bid").isNull(), "libro_sin_bid")
        .when(F.col("ask").isNull(), "libro_sin_ask")
        .when((F.col("bid") <= 0) | (F.col("ask") <= 0) | (F.col("bid") >= F.col("ask")), "bbo_invalido")
        .when(F.col("sell.venue").isNull(), "sin_segundo_venue")
    )
    return books.withColumn("cause", cause).where("cause IS NOT NULL").groupBy("cause").agg(F.count("*").alias("events"))


def quote_funnel(quotes: DataFrame, cands: DataFrame) -> DataFrame:
    """Raw and valid quotes, candidates and the three edge stages in one row."""
    q = quotes.withColumn("cause", quote_cause()).agg(
        F.count("*").alias("raw_quotes"), F.count_if(F.col("cause") == "valid").alias("valid_quotes")
    )
    edge = F.col("gross_bps") - F.col("cost_bps") > 0
    e = cands.agg(
        F.count("*").alias("comparable"), F.count_if(F.col("gross_bps") > 0).alias("gross"),
        F.count_if(edge).alias("net"), F.count_if(edge & (F.col("available") > 0)).alias("liquid_net"),
    )
    out = q.join(F.broadcast(e))  # two one-row tables
    return out.withColumns({f"{n}_per_million": per_million(n, "raw_quotes") for n in ("gross", "net", "liquid_net")})


def invalid_by_cause(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("cause", quote_cause()).where("cause <> 'valid'").groupBy("cause").agg(F.count("*").alias("quotes"))


def decision_funnel(decisions: DataFrame, code: str = "code") -> DataFrame:
    """Stages of the decision log; each stage keeps what the earlier rules did not reject."""
    def n(*codes):
        return F.count_if(F.col(code).isin(*codes))

    out = decisions.agg(
        F.count("*").alias("evaluated"), n("SKIP_STALE").alias("stale"), n("SKIP_THIN_OR_INVENTORY").alias("thin"),
        n("SKIP_MIN_USD").alias("min_usd"), n("SKIP_NET_BPS").alias("net_bps"),
        n("SKIP_CIRCUIT_BREAKER").alias("breaker"),
        n("ACCEPT_EXECUTABLE", "DEMO_PROFITABLE", "PARTIAL_FILL").alias("executable"),
    )
    c = F.col
    return (
        out.withColumn("fresh", c("evaluated") - c("stale")).withColumn("liquid", c("fresh") - c("thin"))
        .withColumn("cost_positive", c("liquid") - c("min_usd") - c("net_bps"))
        .withColumn("risk_allowed", c("cost_positive") - c("breaker"))
    )


# Upper bounds of the latency histogram in milliseconds.
HISTOGRAM_MS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 500.0)


def histogram(df: DataFrame, label: str, value: str, bounds=HISTOGRAM_MS) -> DataFrame:
    """Cumulative histogram per label: rows (label, le, observations) plus count and sum."""
    wide = df.groupBy(label).agg(
        F.count("*").alias("total"), F.sum(value).alias("sum_ms"),
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
    )
    points = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("observations")) for i, b in enumerate(bounds)]
    points.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("observations")))
    return wide.select(label, "total", "sum_ms", F.inline(F.array(*points)))


def venue_coverage(quotes: DataFrame, venues: DataFrame, now, stale: int) -> DataFrame:
    """Configured, seen and fresh venues, and those that share a pair with another fresh venue."""
    last = quotes.groupBy("venue", "pair").agg(F.max("t").alias("t"), F.max_by(F.col("rest"), F.struct("t", "seq")).alias("rest"))
    last = last.withColumn("fresh", now - F.col("t") <= stale)
    pairs = last.where("fresh").groupBy("pair").agg(F.count("*").alias("_k"))
    last = last.join(pairs, "pair", "left")
    hit = last.agg(
        F.count_distinct("venue").alias("active"),
        F.count_distinct(F.when(F.col("fresh"), F.col("venue"))).alias("fresh"),
        F.count_distinct(F.when(F.col("fresh") & ~F.col("rest"), F.col("venue"))).alias("fresh_socket"),
        F.count_distinct(F.when(F.col("fresh") & F.col("rest"), F.col("venue"))).alias("fresh_fallback"),
        F.count_distinct(F.when(F.col("fresh") & (F.col("_k") >= 2), F.col("venue"))).alias("routable"),
    )
    return venues.agg(F.count("*").alias("configured")).join(F.broadcast(hit))
