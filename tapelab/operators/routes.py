"""Routes between venues: detection, ranking, selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab.config import CostModel
from tapelab.functions.costs import opportunity
from tapelab.operators.asof import fresh
from tapelab.operators.funnel import with_venue_config
from tapelab.operators.ordered import BUCKET, bucketed, ranked
from tapelab.session import stage

# Pairs of the triangular cycles.
CYCLES = (("BTC/USD", "ETH/BTC", "ETH/USD"), ("BTC/USDT", "ETH/BTC", "ETH/USDT"))


def route_rows(df: DataFrame, venues: DataFrame, model: CostModel, stale: int | None, t: str = "t") -> DataFrame:
    """All routes of one instant: other venue, same lane unless allowed, bid above ask.

    ``latest`` holds one entry per venue, so the pairs of one row are bounded by the venue table.
    Losing pairs are dropped inside the array, before rows are made.
    """
    lanes = venues.agg(F.map_from_entries(F.collect_list(F.struct("venue", "usd_lane"))).alias("_lanes"))
    df = df.join(F.broadcast(lanes)).withColumn("_live", fresh("latest", t, stale))
    df = df.withColumn("buy", F.explode("_live"))

    def lane(v):
        return F.coalesce(F.element_at("_lanes", v), F.lit(False))

    def ok(x):
        cond = (x["venue"] != F.col("buy.venue")) & (x["bid"] > F.col("buy.ask"))
        return cond if model.allow_cross_lane else cond & (lane(x["venue"]) == lane(F.col("buy.venue")))

    df = df.withColumn("sell", F.explode(F.filter("_live", ok)))
    keep = [c for c in df.columns if c not in (
        "latest", "_live", "_lanes", "buy", "sell", "venue", "bid", "ask", "bid_qty", "ask_qty", "latency_ms")]
    df = df.select(
        *keep, F.col("buy.venue").alias("buy_venue"), F.col("sell.venue").alias("sell_venue"),
        F.col("buy.ask").alias("ask"), F.col("sell.bid").alias("bid"), F.col("buy.ask_qty").alias("buy_depth"),
        F.col("sell.bid_qty").alias("sell_depth"), F.greatest("buy.latency_ms", "sell.latency_ms").alias("latency_ms"),
    )
    return with_venue_config(with_venue_config(df, venues, "buy_venue", "buy_"), venues, "sell_venue", "sell_")


def opportunities(df, venues, model, stale, buy_usd=None, sell_btc=None):
    """Routes with size, costs and decision; balances default to literals."""
    rows = route_rows(df, venues, model, stale)
    usd = F.lit(100000.0) if buy_usd is None else buy_usd
    btc = F.lit(10.0) if sell_btc is None else sell_btc
    return opportunity(rows, model, usd, btc)


def triangular(quotes: DataFrame, venues: DataFrame, model: CostModel, balance_usd, keys: list[str], cycles=CYCLES) -> DataFrame:
    """Three-pair cycles of one venue and instant with a positive yield and enough profit.

    Only the pairs of the two cycles reach the shuffle; one grouped pass gathers the three legs.
    """
    named = [(i, leg, p) for i, c in enumerate(cycles) for leg, p in enumerate(c)]
    tags = F.array_compact(F.array(*[
        F.when(F.col("pair") == p, F.struct(F.lit(i).alias("cycle"), F.lit(leg).alias("leg"))) for i, leg, p in named
    ]))
    rows = quotes.withColumn("_tag", F.explode(tags)).select(*keys, "venue", "ask", "bid", "latency_ms", "_tag.*")

    def at(leg, field):
        return F.max(F.when(F.col("leg") == leg, F.col(field)))

    legs = rows.groupBy(*keys, "venue", "cycle").agg(
        at(0, "ask").alias("p1"), at(1, "ask").alias("p2"), at(2, "bid").alias("p3"),
        F.max("latency_ms").alias("latency_ms"), F.count_distinct("leg").alias("_n"),
    ).where("_n = 3 AND p1 > 0 AND p2 > 0 AND p3 > 0")
    df = with_venue_config(legs, venues, "venue")
    c = F.col
    df = df.withColumn("gross", (1.0 / c("p1")) * (1.0 / c("p2")) * c("p3") - 1.0).where("gross > 0")
    mid = (c("p1") + c("p2") + c("p3")) / 3.0
    df = df.withColumn("qty", F.least(F.lit(model.max_btc), balance_usd / c("p1"))).where("qty > 0")
    cost = (
        c("qty") * c("p1") * c("fee") * 3.0 + c("qty") * mid * model.slippage_bps / 10000.0
        + c("qty") * mid * model.latency_bps / 10000.0
    )
    df = df.withColumn("cost_usd", cost).withColumn("utility_usd", c("gross") * c("qty") - c("cost_usd"))
    df = df.where(c("utility_usd") >= model.min_utility_usd)
    size2 = c("qty") / c("p1")
    legs = F.array(
        F.struct(F.lit("COMPRA").alias("action"), c("p1").alias("price"), c("qty").alias("qty")),
        F.struct(F.lit("COMPRA").alias("action"), c("p2").alias("price"), size2.alias("qty")),
        F.struct(F.lit("VENTA").alias("action"), c("p3").alias("price"), (size2 / c("p2")).alias("qty")),
    )
    return df.withColumn("net_bps", c("utility_usd") / (c("qty") * mid) * 10000.0).withColumn("legs", legs).drop("_n")


# pluggable detection rules by name; each takes its market rows, the venues and the model first
DETECTORS: dict[str, Callable[..., DataFrame]] = {"linear": opportunities, "triangular": triangular}


def register_detector(name: str, fn: Callable[..., DataFrame]) -> None:
    DETECTORS[name] = fn


def detect(name: str, *args, **kw) -> DataFrame:
    return DETECTORS[name](*args, **kw)


def revalidate(opps: DataFrame, model: CostModel) -> DataFrame:
    """Outcome of checking an opportunity against the later quotes of its two venues.

    Input: net_bps at detection, now_buy / now_sell (later quotes or NULL), and the re-evaluated
    now_executable, now_utility, now_net_bps. More than max(shock, 2) / 2 bps lost is a rejection.
    """
    tolerance = max(model.shock_bps, 2.0) / 2.0
    worse = F.col("net_bps") - F.col("now_net_bps") > tolerance
    bad = ~F.col("now_executable") | (F.col("now_utility") <= 0) | worse
    outcome = (
        F.when(F.col("now_buy").isNull() | F.col("now_sell").isNull(), "revalidacion_fallida")
        .when(bad, "revalidacion_rechazada").otherwise("accepted")
    )
    return opps.withColumn("outcome", outcome)


def surplus_match(balances: DataFrame, asset: str, target: str, model: CostModel, min_surplus: float) -> DataFrame:
    """Venues under target with the venue of largest surplus as source and the amount to move.

    The best two surpluses decide every row (a venue cannot be its own source), so no pair of
    venues is formed: the table is reduced to those two and broadcast.
    """
    trigger = min(max(model.rebalance_trigger_pct / 100.0, 0.05), 0.95)
    share = min(max(model.rebalance_transfer_pct / 100.0, 0.05), 1.0)
    s = F.struct((F.col(asset) - F.col(target)).alias("surplus"), F.col("venue").alias("src"))
    top = balances.select(s.alias("s")).orderBy(F.col("s.surplus").desc(), F.col("s.src").desc()).limit(2)
    top = top.agg(F.sort_array(F.collect_list("s"), asc=False).alias("_top"))
    low = balances.where((F.col(target) > 0) & (F.col(asset) < F.col(target) * (1.0 - trigger)))
    df = low.join(F.broadcast(top))
    pick = F.when(F.get("_top", F.lit(0))["src"] != F.col("venue"), F.get("_top", F.lit(0))).otherwise(F.get("_top", F.lit(1)))
    df = df.withColumn("_p", pick).where(F.col("_p.surplus") > min_surplus)
    amount = F.least((F.col(target) - F.col(asset)) * share, F.col("_p.surplus"))
    return df.select("venue", F.col("_p.src").alias("source"), amount.alias("amount"))


def rank_opportunities(df: DataFrame, n: int | None = None) -> DataFrame:
    """Executable first, then by utility."""
    out = df.orderBy(F.col("executable").desc(), F.col("utility_usd").desc(), *[F.col(c) for c in ("buy_venue", "sell_venue", "t", "seq")])
    return out if n is None else out.limit(n)


def top_per_tick(df: DataFrame, tick: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of every tick; Spark keeps only n rows per tick before the shuffle."""
    w = W.partitionBy(*tick).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def rank_candidates(df: DataFrame, tick: list[str], score: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Position (from 1) of the executable rows of every tick, highest ``score`` first, equal scores along ``order``.

    A null score comes last. All rows of a tick get a position, so where one has more rows than a task may
    rank, ticks are spread over buckets of the score. The executable rows are staged: they are read more than once.
    """
    rows = stage(df.where("executable"))
    largest = rows.groupBy(*tick).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    worst = F.when(F.col(score).isNull(), F.lit(float("inf"))).otherwise(-F.col(score).cast("double"))
    rows = ranked(rows.withColumn("_worst", worst), tick, ["_worst", *order], parts, largest=largest)
    return rows.withColumn("position", F.col("rank") + 1).drop("_worst", "rank", "n")


def disjoint_batch(df: DataFrame, tick: list[str], buy_key: str, sell_key: str, limit: int = 4) -> DataFrame:
    """Greedy choice per tick by score: skip a route whose buy or sell key is taken, at most 4.

    The choice inside a tick is sequential. Only the best route per (buy key, sell key) can ever
    be chosen, so the group is first reduced to at most venues x assets rows.
    """
    best = F.row_number().over(W.partitionBy(*tick, buy_key, sell_key).orderBy(F.col("score").desc(), "route"))
    df = df.withColumn("_r", best).where("_r = 1").drop("_r")

    def choose(batches):
        # rows arrive sorted; a tick lies in one task but may span batches
        now, used, left = None, set(), 0
        for pdf in batches:
            keep = []
            for tk, b, s in zip(zip(*[pdf[c] for c in tick]), pdf[buy_key], pdf[sell_key]):
                if tk != now:
                    now, used, left = tk, set(), limit
                take = left > 0 and (0, b) not in used and (1, s) not in used
                if take:
                    used.update(((0, b), (1, s)))
                    left -= 1
                keep.append(take)
            if any(keep):
                yield pdf[keep]

    rows = df.repartition(*tick).sortWithinPartitions(*tick, F.col("score").desc(), "route")
    return rows.mapInPandas(choose, df.schema)


def cooldown(df: DataFrame, keys: list[str], t: str, wait: int, parts: int | None = None) -> DataFrame:
    """Greedy cooldown: times accepted when at least ``wait`` passed since the last accepted one.

    The choice is a chain through the distinct times of a key, so it is cut into buckets. A bucket
    is entered at one of its times less than ``wait`` after its first, or at the next one; for each
    of them the bucket reports the last time it would accept: a bounded list. The lists are followed
    in order per key, which gives every bucket its true entry, and the buckets choose independently.
    """
    times = bucketed(df.select(*keys, t).distinct(), [t], parts)
    group = keys + [BUCKET]
    schema = {f.name: f.dataType.simpleString() for f in times.schema.fields}
    head = ", ".join(f"{k} {schema[k]}" for k in group)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[t].to_numpy())
        nxt = np.searchsorted(x, x + wait)
        out = x.copy()
        for i in range(len(x) - 1, -1, -1):
            out[i] = out[nxt[i]] if nxt[i] < len(x) else x[i]
        # the first time after that span is needed too: it is taken when no earlier one is allowed
        k = min(int(np.searchsorted(x, x[0] + wait)) + 1, len(x))
        row = {c: [pdf[c].iloc[0]] for c in group}
        return pd.DataFrame({**row, "entry": [x[:k].tolist()], "leave": [out[:k].tolist()]})

    lists = times.groupBy(*group).applyInPandas(exits, f"{head}, entry array<bigint>, leave array<bigint>")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BUCKET)
        allowed, starts = None, []
        for entry, leave in zip(pdf["entry"], pdf["leave"]):
            starts.append(entry[0] if allowed is None else allowed)
            i = 0 if allowed is None else int(np.searchsorted(np.asarray(entry), allowed))
            # none of the bucket's times is allowed: nothing changes
            if i < len(entry):
                allowed = int(leave[i]) + wait
        return pd.DataFrame({**{c: pdf[c].tolist() for c in group}, "start": starts})

    starts = lists.groupBy(*keys).applyInPandas(follow, f"{head}, start bigint")
    rows = times.join(starts, group)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[t].to_numpy())
        allowed, keep = pdf["start"].iloc[0], []
        i = int(np.searchsorted(x, allowed))
        while i < len(x):
            keep.append(x[i])
            i = int(np.searchsorted(x, x[i] + wait))
        # plain objects, so that an empty result keeps its columns as simple arrays
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(keep) for k in keys}, t: keep}, dtype=object)

    out = ", ".join(f"{k} {schema[k]}" for k in [*keys, t])
    return rows.groupBy(*group).applyInPandas(pick, out)
