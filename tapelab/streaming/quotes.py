"""Streams of book messages: replay, latest quotes, sequence policy, latency, silence alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapelab.operators.book import sequence_status
from tapelab.operators.ordered import BUCKET, bucketed, newest
from tapelab.operators.retention import last_minutes
from tapelab.session import delete
from tapelab.sources.schemas import TAPE
from tapelab.sources.tape import canonical_events
from tapelab.streaming.state import CarriedState, run


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Shard files as a stream of canonical messages; the same jobs run on it as on live data."""
    raw = spark.readStream.schema(TAPE).option("maxFilesPerTrigger", files_per_batch).option("mode", "FAILFAST").json(path)
    return canonical_events(raw).withColumn("ts", F.timestamp_micros("t"))


def top_of_book(events: DataFrame) -> DataFrame:
    """Best levels of snapshot messages as quotes."""
    top = {"bid": ("bids", "price"), "bid_qty": ("bids", "qty"), "ask": ("asks", "price"), "ask_qty": ("asks", "qty")}
    return events.withColumns({k: F.get(F.col(a), F.lit(0))[b] for k, (a, b) in top.items()}).withColumn("seq", F.col("sequence"))


def latest_quotes(stream: DataFrame) -> DataFrame:
    """Newest quote per market as a streaming aggregate; use output mode update or complete."""
    q = F.struct("t", "seq", "bid", "ask", "bid_qty", "ask_qty", "latency_ms")
    return stream.groupBy("venue", "pair").agg(F.max(q).alias("q"), F.count("*").alias("ingested")).select("venue", "pair", "q.*", "ingested")


_UNDATED = "__HIVE_DEFAULT_PARTITION__"


def retained_history(stream: DataFrame, path: str, checkpoint: str, unit: str = "yyyy-MM-dd-HH", minutes: int = 60):
    """Keep messages in folders per hour (or another ``unit``) and delete folders older than the last ``minutes``.

    A repeated batch writes its own files again; :func:`recent` reads the last minutes.
    """

    def handle(batch: DataFrame, n: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.withColumns({"folder": F.date_format("ts", unit), "batch": F.lit(n)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "batch").parquet(path)
        expire(batch.sparkSession, path, minutes, unit)

    return run(stream, handle, checkpoint)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of a history's folders, oldest first; lists one level, not the files."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)
    return sorted(n.removeprefix("folder=") for n in (f.getPath().getName() for f in found) if n.startswith("folder="))


def _first_folder(spark: SparkSession, path: str, minutes: int, unit: str) -> str | None:
    """The folder in which the last ``minutes`` begin; reads the newest folder only."""
    dated = [n for n in _folders(spark, path) if n != _UNDATED]
    newest = spark.read.parquet(f"{path}/folder={dated[-1]}").agg(F.max("t")).first()[0] if dated else None
    if newest is None:
        return None
    at = F.timestamp_micros(F.lit(newest - minutes * 60_000_000))
    return spark.range(1).select(F.date_format(at, unit)).first()[0]


def expire(spark: SparkSession, path: str, minutes: int, unit: str) -> list[str]:
    """Delete the folders of a history that end before its last ``minutes``; returns their names."""
    first = _first_folder(spark, path, minutes, unit)
    gone = [f"folder={n}" for n in _folders(spark, path) if first is not None and n != _UNDATED and n < first]
    delete(spark, [f"{path}/{n}" for n in gone])
    return gone


def recent(spark: SparkSession, path: str, minutes: int = 60, unit: str = "yyyy-MM-dd-HH", most: int | None = None) -> DataFrame:
    """The last minutes of a history written with the same ``unit``, at most the newest ``most`` rows of them."""
    rows = spark.read.parquet(path).drop("batch")
    first = _first_folder(spark, path, minutes, unit)
    if first is None:
        return rows.where("false")
    rows = last_minutes(rows.where(F.col("folder").cast("string") >= first), "t", minutes)
    return rows if most is None else newest(rows, [], ["t", "seq"], most).drop("newest")


SEQ_STATE = "venue string, pair string, last bigint, broken boolean"


def checked_sequences(stream: DataFrame, rule: str, out: str, late: str, checkpoint: str, state: str):
    """Apply a sequence rule over micro-batches: accepted rows to ``out``, the others to ``late``.

    A market's state is put before its batch as a snapshot with the last accepted number (and a
    gap if it is waiting), so the batch operator continues where the last batch stopped.
    """
    carried = CarriedState(state, SEQ_STATE)

    def handle(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = carried.load(spark, n)
        low = F.lit(-(2**62))
        cols = ["venue", "pair", "t", "seq", "kind", "sequence", "previous"]
        head = old.where("last IS NOT NULL").select("venue", "pair", low.alias("t"), F.lit(0).cast("bigint").alias("seq"), F.lit("snapshot").alias("kind"), F.col("last").alias("sequence"), F.lit(None).cast("bigint").alias("previous"))
        gap = old.where("broken").select("venue", "pair", low.alias("t"), F.lit(1).cast("bigint").alias("seq"), F.lit("delta").alias("kind"), (F.col("last") + 2).alias("sequence"), (F.col("last") + 1).alias("previous"))
        rows = batch.select(*cols).unionByName(head).unionByName(gap)
        # written once: the results below all read it
        tmp = f"{state}/status/v={n}"
        sequence_status(rows, rule).write.mode("overwrite").parquet(tmp)
        st = spark.read.parquet(tmp)
        mine = st.where(F.col("t") > low)
        mine.where("accepted").drop("accepted", "epoch").withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}")
        mine.where("NOT accepted").drop("accepted", "epoch").withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{late}/b={n}")
        ends = st.groupBy("venue", "pair").agg(F.max("epoch").alias("_e"))
        cur = st.join(ends, ["venue", "pair"]).where(F.col("epoch") == F.col("_e"))
        new = cur.groupBy("venue", "pair").agg(
            F.max(F.when(F.col("accepted"), F.col("sequence"))).alias("last"), F.bool_or(F.col("status") == "gap_requiere_snapshot").alias("broken"))
        # markets without rows in this batch are in st through their head row
        carried.save(new, n)

    return run(stream, handle, checkpoint)


EWMA_STATE = "venue string, n bigint, ewma double"


def latency_ewma(stream: DataFrame, checkpoint: str, state: str, alpha: float = 0.10):
    """Smoothed latency per venue over micro-batches; the newest state table is the result.

    A batch of m rows maps the state x to (1-a)^m x + b, with b a weighted sum, so even one venue's
    batch is computed by many tasks.
    """
    carried = CarriedState(state, EWMA_STATE)

    def handle(batch: DataFrame, n: int) -> None:
        old = carried.load(batch.sparkSession, n)
        part = affine_ewma(batch, ["venue"], ["t", "seq"], "latency_ms", alpha)
        j = part.join(old.select("venue", F.col("n").alias("_n"), F.col("ewma").alias("_x")), "venue", "full")
        seed = F.coalesce("_x", "first")
        # the very first value enters whole: it acts as the seed of its own batch
        x = F.when(F.col("m").isNull(), F.col("_x")).otherwise(seed * F.pow(F.lit(1.0 - alpha), F.col("m").cast("double")) + F.col("b"))
        carried.save(j.select("venue", (F.coalesce("m", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), x.alias("ewma")), n)

    return run(stream, handle, checkpoint)


def affine_ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """Per key the map x -> (1-a)^m x + b of a batch, and its first value."""
    from pyspark.sql import Window as W

    rows = bucketed(df, order)
    group = keys + [BUCKET]
    later = W.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*group).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_after", F.coalesce(F.sum("_c").over(later), F.lit(0)))
    inside = W.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    rows = rows.withColumn("_i", F.row_number().over(inside) - 1).join(counts, group)
    age = (F.col("_after") + F.col("_i")).cast("double")
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("m"), F.sum(F.pow(F.lit(1.0 - alpha), age) * v * alpha).alias("b"), F.min(F.struct(*order, v.alias("_v")))["_v"].alias("first"))


class _Silence(StatefulProcessor):
    """Emits a row when a market has been silent for the limit."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        top = max(int(pdf["t"].max()) for pdf in rows)
        if self.last.exists():
            top = max(top, self.last.get()[0])
        self.last.update((top,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.limit_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"venue": [key[0]], "pair": [key[1]], "last_t": [self.last.get()[0]]})

    def close(self) -> None:
        pass


def silence_alerts(stream: DataFrame, stale_ms: int) -> DataFrame:
    """Markets without a message for ``stale_ms`` of wall time (needs the RocksDB state store)."""
    return stream.select("venue", "pair", "t").groupBy("venue", "pair").transformWithStateInPandas(
        statefulProcessor=_Silence(stale_ms), outputStructType="venue string, pair string, last_t bigint", outputMode="Update", timeMode="ProcessingTime")
