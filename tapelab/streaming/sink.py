"""Stream sinks: exactly-once audit log and rotating shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.sources.audit_log import append
from tapelab.streaming.state import run


def audit_sink(rows: DataFrame, path: str, checkpoint: str, lateness: str | None = None):
    """Append log rows once per (kind, id), also after a restart or a repeated batch.

    ``lateness`` first drops repeats that arrive close together inside the stream's own state.
    """
    if lateness:
        rows = rows.withWatermark("time", lateness).dropDuplicatesWithinWatermark(["kind", "id"])
    return run(rows, lambda batch, n: append(batch, path), checkpoint)


def shard_sink(stream: DataFrame, path: str, checkpoint: str, minutes: int = 30, ts: str = "ts"):
    """Write messages into one folder per ``minutes`` window; manifests are derived afterwards."""
    shard = F.date_format(F.window(F.col(ts), f"{minutes} minutes").getField("start"), "yyyyMMdd-HHmm")
    q = stream.withColumn("shard", shard).writeStream.format("json").partitionBy("shard").option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def upsert_sink(out: DataFrame, path: str, checkpoint: str) -> None:
    """What changed in every micro-batch as Parquet rows with their batch number; state may end behind a watermark."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(path)

    out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of every key; a batch written twice after a failure does not show."""
    rows = spark.read.parquet(path)
    rest = F.struct(*[c for c in rows.columns if c not in (*keys, "_batch")])
    return rows.groupBy(*keys).agg(F.max_by(rest, "_batch").alias("_last")).select(*keys, "_last.*")
