"""Streaming detection of cross-venue candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.config import CostModel
from tapelab.operators.funnel import PAYLOAD, candidates
from tapelab.streaming.state import CarriedState, run

FIELDS = ["venue", "pair", "t", "seq", *PAYLOAD]
STATE = "venue string, pair string, t bigint, seq bigint, bid double, ask double, bid_qty double, ask_qty double, latency_ms bigint"


def detect(stream: DataFrame, venues: DataFrame, model: CostModel, stale: int, out: str, checkpoint: str, state: str, names: list[str]):
    """Best cross-venue pair with costs for every message, micro-batch by micro-batch.

    The newest quote of every market is carried between batches and joins the batch as earlier
    rows. The batch itself goes through the batch operator, which spreads a busy pair over tasks.
    ``names`` are the configured venues. Each batch overwrites its own folder below ``out``.
    """
    carried = CarriedState(state, STATE)

    def handle(batch: DataFrame, n: int) -> None:
        old = carried.load(batch.sparkSession, n).withColumn("_old", F.lit(True))
        rows = batch.select(*FIELDS).withColumn("_old", F.lit(False)).unionByName(old)
        c = candidates(rows, venues, model, stale, names=names).where("NOT _old").drop("_old")
        keep = ["venue", "pair", "t", "seq", "buy_venue", "sell_venue", "ask", "bid", "available", "qty", "costs", "latency_ms", "gross_bps", "cost_bps"]
        c.select(*keep).write.mode("overwrite").parquet(f"{out}/b={n}")
        new = rows.groupBy("venue", "pair").agg(F.max(F.struct("t", "seq", *PAYLOAD)).alias("q")).select("venue", "pair", "q.*")
        carried.save(new.select(*FIELDS), n)

    return run(stream, handle, checkpoint)
