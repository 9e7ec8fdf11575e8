"""State that ends: the last minutes of every market, and markets that fell silent, both in event time.

Both operators need the RocksDB state store (:func:`with_state_store`) and a stream with a
``timestamp`` column ``ts`` under a watermark. What is older than the watermark allows is dropped
by the engine before it reaches them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that state variables and timers need, for streams started and ended inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Cell(StatefulProcessor):
    """Rows of one cell of time, forgotten by a timer; what was forgotten is reported once.

    The state holds the rows of a piece of input as one element with an array per column.
    """

    def __init__(self, cell_ms: int, keep_ms: int) -> None:
        self.cell_ms, self.keep_ms = cell_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "t array<bigint>, seq array<bigint>, bid array<double>, ask array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            self.handle.registerTimer((int(key[2]) + 1) * self.cell_ms + self.keep_ms)
        for pdf in rows:
            self.rows.appendValue(tuple(pdf[c].tolist() for c in ("t", "seq", "bid", "ask")))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = np.concatenate([np.array(r[0], np.int64) for r in self.rows.get()])
        self.rows.clear()
        yield pd.DataFrame({"venue": [key[0]], "pair": [key[1]], "cell": [key[2]], "rows": [len(t)], "first_t": [t.min()], "last_t": [t.max()]})

    def close(self) -> None:
        pass


def rolling_state(stream: DataFrame, minutes: int = 60, cell_seconds: int = 60) -> DataFrame:
    """Keeps the last ``minutes`` of every market in state; the result reports the cells forgotten.

    State is keyed by market and cell of ``cell_seconds``, so a hot market lies in many tasks. A cell
    goes when the watermark passes its end by ``minutes``. :func:`retained` reads what is kept.
    """
    cell_ms = cell_seconds * 1000
    cell = F.expr(f"unix_millis(ts) div {cell_ms}")
    rows = stream.select("venue", "pair", cell.alias("cell"), "t", "seq", "bid", "ask", "ts")
    return rows.groupBy("venue", "pair", "cell").transformWithStateInPandas(
        statefulProcessor=_Cell(cell_ms, minutes * 60_000), outputMode="Append", timeMode="EventTime",
        outputStructType="venue string, pair string, cell bigint, rows bigint, first_t bigint, last_t bigint")


def retained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state of :func:`rolling_state` holds, read from the checkpoint of its stream."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").load()
    return rows.select("key.*", F.expr("inline(arrays_zip(list_element.t, list_element.seq, list_element.bid, list_element.ask)) AS (t, seq, bid, ask)"))


class _Feed(StatefulProcessor):
    """Silences of one market: closed ones between its messages, an open one by a timer."""

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = np.sort(np.concatenate([pdf["t"].to_numpy(np.int64) for pdf in rows]))
        if self.last.exists():
            t = np.sort(np.append(t, self.last.get()[0]))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.last.update((int(t[-1]),))
        self.handle.registerTimer((int(t[-1]) + self.limit_us) // 1000 + 1)
        gap = np.diff(t)
        at = np.flatnonzero(gap > self.limit_us)
        yield pd.DataFrame({"venue": key[0], "pair": key[1], "last_seen": t[at], "silent_us": gap[at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"venue": [key[0]], "pair": [key[1]], "last_seen": [self.last.get()[0]], "silent_us": [0]})

    def close(self) -> None:
        pass


def silences(stream: DataFrame, limit_us: int) -> DataFrame:
    """A row with ``silent_us`` 0 when the watermark finds a market silent for the limit, and one with the length when it speaks again.

    A task holds the times of one market's messages of one micro-batch, which the trigger bounds;
    state is one number a market. :func:`last_word` joins both kinds of rows.
    """
    return stream.select("venue", "pair", "t", "ts").groupBy("venue", "pair").transformWithStateInPandas(
        statefulProcessor=_Feed(limit_us), outputMode="Append", timeMode="EventTime",
        outputStructType="venue string, pair string, last_seen bigint, silent_us bigint")


def last_word(alerts: DataFrame) -> DataFrame:
    """One row per silence; ``silent_us`` is null while it lasts."""
    n = F.max("silent_us")
    return alerts.groupBy("venue", "pair", "last_seen").agg(F.when(n > 0, n).alias("silent_us"))


def to_table(out: DataFrame, path: str, checkpoint: str) -> None:
    """Run an appending stream to its end into Parquet files, each batch once."""
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
