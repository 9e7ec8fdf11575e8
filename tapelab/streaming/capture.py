"""Rotating shards of a recorded stream: bounded files with manifests, numbered on, failed ones set aside.

A shard is a folder ``shard-<number>-<time of its first event>`` with ``events.jsonl``,
``capture-config.json`` and ``manifest.json``, as the corpus readers and checks expect it. A micro-batch is
cut into windows of time, and a window into files of at most ``rows`` events, so that a task writes and a
task reads one bounded file however many events fall into a window. The files are written and read
back by Spark jobs; the driver sees one row per shard of the batch and renames folders.

What makes a repeated batch give the same corpus: the names of a batch's shards are written once, before
the first of them; a manifest is written last, so a folder without one is a shard that was cut off, which
goes aside under ``failed-`` and is written again. Numbers go on behind the highest in the folder.
"""

from __future__ import annotations

import hashlib
import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.operators.ordered import ranked
from tapelab.plans.corpus import COUNTS, LOSS_POLICY, derive_manifests, event_flags, reconcile, verify_tape
from tapelab.session import stage, staging
from tapelab.sources.files import mounted
from tapelab.sources.tape import QUARANTINE, TIME_FORMAT, event_rows, file_hashes, read_tape
from tapelab.streaming.state import run

ROWS = 1_000_000
MOST_FAILURES = 3  # in a row, then the capture stops


class Folder:
    """Files of a corpus in whatever store its path names; a mounted one is reached by plain calls."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root
        self.top = mounted(spark, root)
        self.fs = self.at(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.at(root))

    def path(self, name: str):
        return self.at(f"{self.root}/{name}")

    def names(self, folder: str = ".") -> list[str]:
        if self.top:
            return os.listdir(f"{self.top}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))]

    def has(self, name: str) -> bool:
        return os.path.exists(f"{self.top}/{name}") if self.top else self.fs.exists(self.path(name))

    def make(self, name: str) -> None:
        if self.top:
            os.makedirs(f"{self.top}/{name}", exist_ok=True)
        else:
            self.fs.mkdirs(self.path(name))

    def move(self, old: str, new: str) -> None:
        if self.top:
            os.rename(f"{self.top}/{old}", f"{self.top}/{new}")
        elif not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write(self, name: str, text: str) -> None:
        if self.top:
            place, last = os.path.split(f"{self.top}/{name}")
            os.makedirs(place, exist_ok=True)
            with open(f"{place}/.{last}.new", "wb") as out:
                out.write(text.encode())
            os.replace(f"{place}/.{last}.new", f"{place}/{last}")
            return
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        if self.top:
            with open(f"{self.top}/{name}", encoding="utf-8") as source:
                return source.read()
        source = self.fs.open(self.path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


def set_aside(folder: Folder, name: str) -> str:
    """Renames a shard so that no reader takes it; an earlier one of that name stays."""
    free, k = f"{QUARANTINE}{name}", 1
    while folder.has(free):
        k += 1
        free = f"{QUARANTINE}{name}.{k}"
    folder.move(name, free)
    return free


def next_number(names: list[str]) -> int:
    """One more than the highest number of a shard, also of one set aside; 0 in an empty folder."""
    found = [n.removeprefix(QUARANTINE).split("-") for n in names if n.removeprefix(QUARANTINE).startswith("shard-")]
    return 1 + max((int(p[1]) for p in found if p[1].isdigit()), default=-1)


def cut(events: DataFrame, minutes: int, rows: int, order: list[str]) -> DataFrame:
    """Events with ``cut``: the start of their window in microseconds and the file in it; they are ranked only where a window needs several files."""
    width = minutes * 60_000_000
    out = events.withColumn("_window", F.col("t") - F.pmod(F.col("t"), F.lit(width)))
    largest = out.groupBy("_window").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    if largest <= rows:
        return out.withColumn("cut", F.concat_ws("-", "_window", F.lit("0"))).drop("_window", "rank", "n")
    out = ranked(out, ["_window"], order, largest=largest)
    return stage(out.withColumn("cut", F.concat_ws("-", "_window", F.floor(F.col("rank") / rows).cast("string"))).drop("_window", "rank", "n"))


def write_batch(batch: DataFrame, number: int, root: str, minutes: int, rows: int, order: list[str], facts: dict, state: dict) -> None:
    """One micro-batch as shards under ``root``; ``state`` counts failed shards in a row."""
    spark = batch.sparkSession
    folder = Folder(spark, root)
    with staging(spark):
        received = stage(batch)  # its lines are parsed once
        if received.isEmpty():
            return
        events = cut(received, minutes, rows, order)
        expected = derive_manifests(event_flags(events).withColumnRenamed("cut", "shard"))
        work = f"_work/batch={number}"
        sized = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cut").sortWithinPartitions("cut", *order)
        event_rows(sized, "cut").write.mode("overwrite").partitionBy("cut").option("timestampFormat", TIME_FORMAT).json(f"{root}/{work}")

        # read back: what the files hold is compared with what was received
        named = F.regexp_extract("shard", r"^cut=(.*)$", 1)
        back = stage(read_tape(spark, f"{root}/{work}/*/*.json").withColumn("shard", named))
        files = file_hashes(spark, f"{root}/{work}").select(F.regexp_extract("path", r"cut=([^/]+)/", 1).alias("shard"), "path", F.col("bytes").alias("size"), "sha256")
        found = stage(derive_manifests(event_flags(back)))
        wrong = reconcile(found.drop("bytes").withColumn("bytes", F.lit(0).cast("bigint")), expected)
        wrong = wrong.unionByName(verify_tape(back).select("shard", F.col("failure").alias("reason"))).groupBy("shard").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
        shards = found.join(files, "shard").join(wrong, "shard", "left").orderBy("started", "shard").collect()  # a row per shard of this batch

    plan = f"_plan/{number}.json"
    if folder.has(plan):
        names = json.loads(folder.read(plan))
    else:
        first = next_number(folder.names())
        names = {s["shard"]: f"shard-{first + i:06d}-{datetime.fromtimestamp(s['started'] // 1_000_000, timezone.utc):%Y%m%dT%H%M%SZ}" for i, s in enumerate(shards)}
        folder.write(plan, json.dumps(names))
    aside = [n for n in folder.names() if n.startswith(QUARANTINE)]
    for s in shards:
        name = names[s["shard"]]
        judged = any(n.startswith(f"{QUARANTINE}{name}") and folder.has(f"{n}/failed.json") for n in aside)
        if judged or folder.has(f"{name}/manifest.json"):
            continue  # done before the batch was repeated
        if folder.has(name):
            set_aside(folder, name)
        publish(folder, name, s, facts, work)
        state["failures"] = state.get("failures", 0) + 1 if s["reasons"] else 0
        if state["failures"] >= MOST_FAILURES:
            raise RuntimeError(f"{MOST_FAILURES} shards in a row failed; the last, {name}: {', '.join(s['reasons'])}")
    folder.delete(work)


def publish(folder: Folder, name: str, s, facts: dict, work: str) -> None:
    """Moves a written file to its shard and commits it by its manifest, or sets it aside with the reasons."""
    stamp = lambda us: datetime.fromtimestamp(us / 1_000_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    config = json.dumps({"schemaVersion": 1, "pair": s["pairs"][0], "exchanges": s["venues"], "depth": facts["depth"]})
    folder.make(name)
    folder.move(f"{work}/cut={s['shard']}/{s['path'].rsplit('/', 1)[1]}", f"{name}/events.jsonl")
    folder.write(f"{name}/capture-config.json", config)
    if s["reasons"]:
        folder.write(f"{name}/failed.json", json.dumps({"reasons": s["reasons"]}))
        set_aside(folder, name)
        return
    counts = dict(zip(("events", "snapshots", "sequenceGaps", "restFallbackEvents", "reconnectEvents"), (s[c] for c in COUNTS)))
    folder.write(f"{name}/manifest.json", json.dumps({
        "schemaVersion": 1, "datasetId": name, "sourceClassification": facts["classification"], "startedAt": stamp(s["started"]), "endedAt": stamp(s["ended"]),
        "exchanges": s["venues"], "pairs": s["pairs"], **counts, "deliveryPolicy": LOSS_POLICY, "eventsByExchange": s["by_venue"], "uncompressedBytes": s["size"],
        "durationMs": s["duration_ms"], "sha256": s["sha256"], "gitCommit": facts["commit"], "gitDirty": facts["dirty"],
        "configSha256": hashlib.sha256(config.encode()).hexdigest()}))


def capture(stream: DataFrame, root: str, checkpoint: str, minutes: int = 30, rows: int = ROWS, order: tuple[str, ...] = ("t", "sequence"),
            classification: str = "public_market_capture", commit: str = "", dirty: bool = True, depth: int = 10, available_now: bool = True):
    """Records a stream of canonical messages as a corpus under ``root``; see the module for the layout.

    A shard whose file does not hold what was received, or holds bad levels, an unknown version or times
    or numbers that go back, is set aside with its reasons in ``failed.json``; ``MOST_FAILURES`` of them in
    a row stop the stream. Events stand in ``order``. An empty batch leaves nothing.
    """
    facts, state = {"classification": classification, "commit": commit, "dirty": dirty, "depth": depth}, {}
    return run(stream, lambda batch, n: write_batch(batch, n, root, minutes, rows, list(order), facts, state), checkpoint, available_now)
