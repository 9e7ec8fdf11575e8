"""As-of alignment of venues: what every other venue last quoted at each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab.operators.ordered import BUCKET, FIRST, Cuts, bucketed


def venue_names(quotes: DataFrame) -> list[str]:
    """Distinct venues. Their number is that of configured feeds, not of rows."""
    return sorted(r[0] for r in quotes.select("venue").distinct().collect() if r[0] is not None)


def latest_by_venue(
    quotes: DataFrame, payload: list[str], by: list[str] | None = None, venues: list[str] | None = None,
    t: str = "t", tie: str = "seq", parts: int | None = None, cuts: Cuts | None = None,
) -> DataFrame:
    """Add ``latest``: the newest quote of every venue up to and including each row.

    ``by`` lists the grouping keys (default: pair; empty keeps one state for all pairs). Each entry
    is struct(t, seq, venue, payload...). Two passes: the last quote per (key, bucket, venue) is
    carried forward over the small bucket table, then a window inside each bucket starts from it.
    """
    by = ["pair"] if by is None else by
    venues = venues or venue_names(quotes)
    rows = bucketed(quotes, [t, tie], parts, cuts)
    entry = F.struct(F.col(t).alias("t"), F.col(tie).alias("seq"), F.col("venue"), *[F.col(p) for p in payload])
    group = by + [BUCKET]
    cols = [f"_v{i}" for i in range(len(venues))]
    mine = [F.when(F.col("venue") == v, entry) for v in venues]

    ends = rows.groupBy(*group).agg(*[F.max(m).alias(c) for m, c in zip(mine, cols)])
    before = W.partitionBy(*by).orderBy(BUCKET).rowsBetween(FIRST, -1)
    carry = ends.select(*group, *[F.last(c, ignorenulls=True).over(before).alias(c) for c in cols])
    carry = carry.withColumn("_event", F.lit(0))

    events = rows.withColumn("_event", F.lit(1))
    for m, c in zip(mine, cols):
        events = events.withColumn(c, m)
    both = events.unionByName(carry, allowMissingColumns=True)
    w = W.partitionBy(*group).orderBy("_event", t, tie).rowsBetween(FIRST, 0)
    both = both.select(
        *[c for c in events.columns if c not in cols], *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols]
    )
    return (
        both.where("_event = 1")
        .withColumn("latest", F.array_compact(F.array(*cols)))
        .drop("_event", BUCKET, *cols)
    )


def fresh(latest, t, stale: int | None) -> Column:
    """Entries not older than ``stale`` time units at ``t``."""
    if stale is None:
        return F.col(latest) if isinstance(latest, str) else latest
    return F.filter(latest, lambda x: F.col(t) - x["t"] <= stale)


def best_pair(df: DataFrame, stale: int | None = None, t: str = "t") -> DataFrame:
    """Add ``buy`` (lowest ask) and ``sell`` (highest bid among the other venues).

    Equal prices go to the alphabetically first venue. ``sell`` is NULL without a second venue.
    """
    df = df.withColumn("_fresh", fresh("latest", t, stale))
    buys = F.transform("_fresh", lambda x: F.struct(x["ask"].alias("p"), x["venue"].alias("v"), x.alias("q")))
    df = df.withColumn("buy", F.array_min(buys)["q"])
    others = F.filter("_fresh", lambda x: x["venue"] != F.col("buy.venue"))
    sells = F.transform(others, lambda x: F.struct((-x["bid"]).alias("p"), x["venue"].alias("v"), x.alias("q")))
    return df.withColumn("sell", F.array_min(sells)["q"]).drop("_fresh")


def spread_series(df: DataFrame) -> DataFrame:
    """Cross-venue spread (highest mid - lowest mid) / centre in bps, once two venues are known."""
    mids = F.transform("latest", lambda x: (x["bid"] + x["ask"]) / 2.0)
    hi, lo = F.array_max(mids), F.array_min(mids)
    mid = (hi + lo) / 2.0
    return df.where(F.size("latest") >= 2).withColumn("spread_bps", (hi - lo) / mid * 10000.0).where(mid > 0)


def asynchrony(t: str = "t", latest: str = "latest") -> Column:
    """Age of the oldest 'last seen' venue at each event."""
    return F.greatest(F.col(t) - F.array_min(F.transform(latest, lambda x: x["t"])), F.lit(0))


def asof_quotes(
    probes: DataFrame, quotes: DataFrame, payload: list[str], keys: list[str],
    t: str = "t", tie: str = "seq", parts: int | None = None,
) -> DataFrame:
    """Left as-of join: add ``quote``, the newest row of ``quotes`` with t <= probe t per key.

    Works like :func:`latest_by_venue` with one carried value per key; a market with a third of
    all rows is still spread over the buckets.
    """
    entry = F.struct(F.col(t).alias("t"), F.col(tie).alias("seq"), *[F.col(p) for p in payload])
    right = quotes.select(*keys, t, F.col(tie).cast("bigint").alias(tie), entry.alias("_q")).withColumn("_probe", F.lit(0))
    left = probes.withColumn("_probe", F.lit(1))
    if tie not in left.columns:
        left = left.withColumn(tie, F.lit(None).cast("bigint"))
    both = bucketed(left.unionByName(right, allowMissingColumns=True), [t], parts)
    group = keys + [BUCKET]
    ends = both.groupBy(*group).agg(F.max("_q").alias("_end"))
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(FIRST, -1)
    carry = ends.select(
        *group, F.last("_end", ignorenulls=True).over(before).alias("_q"), F.lit(-1).alias("_probe")
    )
    both = both.unionByName(carry, allowMissingColumns=True)
    # the carried row sorts first (NULL time), then quotes before probes of the same instant
    w = W.partitionBy(*group).orderBy(F.col(t).asc_nulls_first(), "_probe", F.col(tie)).rowsBetween(FIRST, 0)
    both = both.withColumn("quote", F.last("_q", ignorenulls=True).over(w))
    return both.where("_probe = 1").drop("_probe", "_q", BUCKET)
