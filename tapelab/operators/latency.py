"""Venue latency: summary, state and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab.functions.quality import latency_state, region_hint
from tapelab.operators.ordered import ewma, newest, running

HISTORY = 100


def latency_summary(quotes: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Per venue: count, min, max, last and quantiles of the last 100 values (floor rule)."""
    order = ["t", "seq"]
    whole = quotes.groupBy("venue").agg(
        F.count("*").alias("events"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
        F.max(F.struct(*order, value))[value].alias("last_ms"),
    )
    last = newest(quotes.select("venue", *order, value), ["venue"], order, HISTORY)
    # at most 100 values per venue
    vals = last.groupBy("venue").agg(F.array_sort(F.collect_list(value)).alias("_l"))

    def at(q):
        n = F.size("_l")
        return F.get("_l", F.least(F.floor(n * q), n - 1).cast("int"))

    return whole.join(vals, "venue").withColumns({"p50_ms": at(0.5), "p95_ms": at(0.95), "p99_ms": at(0.99)}).drop("_l")


def latency_ranking(quotes: DataFrame, stale_ms: int, value: str = "latency_ms") -> DataFrame:
    """Venues by smoothed latency, fastest first, with state and replica hint (one row per venue)."""
    m = ewma(quotes, ["venue"], ["t", "seq"], value, 0.10)
    place = F.row_number().over(W.orderBy("ewma", "venue")).cast("bigint")
    return m.select(
        "venue", place.alias("place"), latency_state("ewma", stale_ms).alias("state"),
        region_hint("venue", "ewma").alias("region"),
    )


def feed_gaps(quotes: DataFrame, stale: int) -> DataFrame:
    """Silences of a feed longer than ``stale``: from a message to the next one of its market."""
    prev = running(quotes.select("venue", "pair", "t", "seq"), ["venue", "pair"], ["t", "seq"], {"_p": ("max", "t")}, exclusive=True)
    return prev.where(F.col("t") - F.col("_p") > stale).select(
        "venue", "pair", F.col("_p").alias("last_seen"), (F.col("t") - F.col("_p")).alias("silent_us"))
