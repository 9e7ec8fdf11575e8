"""Small versioned state tables for micro-batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class CarriedState:
    """What one micro-batch leaves to the next, one folder per batch.

    Batch n reads version n-1 and overwrites version n, so a repeated batch after a failure gives
    the same result. The table holds one row per market or venue, not the history.
    """

    def __init__(self, path: str, schema: str) -> None:
        self.path, self.schema = path, schema

    def load(self, spark: SparkSession, batch: int) -> DataFrame:
        if batch == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/v={batch - 1}")

    def save(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")


def run(stream: DataFrame, handle, checkpoint: str, available_now: bool = True, every: str = "5 seconds"):
    """Start ``handle(batch_df, batch_id)`` on a stream; with ``available_now`` wait for the end."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
    if available_now:
        q.awaitTermination()
    return q
