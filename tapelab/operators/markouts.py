"""What the mid price does after a quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.operators.asof import asof_quotes
from tapelab.operators.ordered import Cuts, _same, ranked, rolling_rows

# Look-ahead in events of the same market.
HORIZONS = (1, 5, 10, 25)


def event_markouts(df: DataFrame, keys: list[str], order: list[str], mid: str = "mid", horizons=HORIZONS, parts: int | None = None, cuts: Cuts | None = None) -> DataFrame:
    """Add markout_e1, e5, e10, e25 in bps; beyond the end the market's last mid counts."""
    rows = ranked(df, keys, order, parts, cuts)
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, mid))[mid].alias("_last"))
    aggs = {f"_m{h}": (lambda w, h=h: F.lead(mid, h).over(w)) for h in horizons}
    rows = rolling_rows(rows, keys, order, aggs, ahead=max(horizons), ready=True)
    rows = _same(rows, last, keys)
    for h in horizons:
        rows = rows.withColumn(f"markout_e{h}", (F.coalesce(f"_m{h}", "_last") / F.col(mid) - 1.0) * 10000.0)
    return rows.drop("rank", "n", "_last", *[f"_m{h}" for h in horizons])


def time_markout(df: DataFrame, keys: list[str], horizon: int, mid: str = "mid") -> DataFrame:
    """Markout after a real time span: the market's mid as of t + horizon."""
    probes = df.withColumns({"_t": F.col("t"), "_seq": F.col("seq"), "t": F.col("t") + horizon}).drop("seq")
    out = asof_quotes(probes, df.select(*keys, "t", "seq", mid).withColumnRenamed(mid, "_mid"), ["_mid"], keys)
    out = out.withColumns({"t": F.col("_t"), "seq": F.col("_seq")}).drop("_t", "_seq")
    return out.withColumn("markout", (F.col("quote._mid") / F.col(mid) - 1.0) * 10000.0).drop("quote")
