"""State and folders that end: expiry of old messages, silences, over several batches."""

import os

import pytest
from pyspark.sql import functions as F

from tapelab.streaming import history as H
from tapelab.streaming import quotes as Q

MINUTE = 60_000_000
DAY = 24 * 60  # the watermark starts at zero
SCHEMA = "venue string, pair string, t bigint, seq bigint, bid double, ask double"


def add(spark, path, rows):
    spark.createDataFrame([(v, "P", (DAY + t) * MINUTE, i, 1.0, 2.0) for i, (v, t) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", "0 seconds")


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("in", "out", "cp")]


def test_state_forgets_old_cells(spark, places):
    src, out, cp = places
    with H.with_state_store(spark):
        add(spark, src, [("A", 0), ("A", 0), ("B", 1), ("A", 5)])
        H.to_table(H.rolling_state(stream(spark, src), minutes=10), out, cp)
        assert spark.read.parquet(out).count() == 0
        assert {(r.venue, r.t // MINUTE - DAY) for r in H.retained(spark, cp).collect()} == {("A", 0), ("B", 1), ("A", 5)}
        # the query starts again from its checkpoint
        add(spark, src, [("A", 14), ("C", 14)])
        H.to_table(H.rolling_state(stream(spark, src), minutes=10), out, cp)
    gone = {(r.venue, r.cell - DAY, r.rows) for r in spark.read.parquet(out).collect()}
    assert gone == {("A", 0, 2), ("B", 1, 1)}
    assert sorted((r.venue, r.t // MINUTE - DAY) for r in H.retained(spark, cp).collect()) == [("A", 5), ("A", 14), ("C", 14)]


def test_silence_opens_and_closes(spark, places):
    src, out, cp = places
    limit = 10 * MINUTE
    with H.with_state_store(spark):
        add(spark, src, [("A", 0), ("A", 20), ("B", 19), ("B", 40)])
        H.to_table(H.silences(stream(spark, src), limit), out, cp)
        rows = {(r.venue, r.last_seen // MINUTE - DAY): r.silent_us for r in H.last_word(spark.read.parquet(out)).collect()}
        assert rows == {("A", 0): 20 * MINUTE, ("B", 19): 21 * MINUTE, ("A", 20): None}  # A is silent at 40
        add(spark, src, [("A", 45), ("B", 50)])
        H.to_table(H.silences(stream(spark, src), limit), out, cp)
    rows = {(r.venue, r.last_seen // MINUTE - DAY): r.silent_us for r in H.last_word(spark.read.parquet(out)).collect()}
    # exactly the limit is no silence
    assert rows == {("A", 0): 20 * MINUTE, ("B", 19): 21 * MINUTE, ("A", 20): 25 * MINUTE}


def test_old_folders_are_deleted(spark, places):
    src, out, cp = places
    for n, rows in enumerate([[("A", 0), ("A", 59)], [("A", 61), ("B", 119)], [("A", 200), ("A", 200)]]):
        add(spark, src, rows)
        Q.retained_history(stream(spark, src), out, cp)
        folders = sorted(f for f in os.listdir(out) if f.startswith("folder="))
        assert folders == [["folder=1970-01-02-00"], ["folder=1970-01-02-00", "folder=1970-01-02-01"], ["folder=1970-01-02-03"]][n]
    assert Q.recent(spark, out).count() == 2
    assert Q.recent(spark, out, most=1).count() == 1
