"""Session helpers: settings for local runs and durable staging of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[str] = []
BROADCAST_LIMIT = 32 * 1024 * 1024


def local_session(cpus: int | str = 8, shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tapelab")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local path
    would not be readable by the other executors, so a missing setting is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tapelab-"))
    return spark.sparkContext.getCheckpointDir()


def small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast if the planner's size estimate is within the limit.

    Beyond it the join is left to the planner, which then shuffles both sides.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_LIMIT else df


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several later steps need the same costly rows. The table survives the loss of
    executors, unlike a cached block, and has statistics for the planner.
    """
    path = f"{staging_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, names: list[str]) -> None:
    """Delete files or folders, wherever they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes on leaving what was staged inside, but for tables staged by the function it yields.

    Write or collect a result before leaving, or stage it by that function.
    """
    mark, kept = len(_staged), []

    def keep(df: DataFrame) -> DataFrame:
        out = stage(df)
        kept.append(_staged[-1])
        return out

    try:
        yield keep
    finally:
        gone = [name for name in _staged[mark:] if name not in kept]
        _staged[mark:] = kept
        delete(spark, gone)


def unstage(df: DataFrame) -> None:
    """Deletes the staged table that ``df`` reads, if it is one."""
    folders = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    gone = [name for name in _staged if os.path.basename(name) in folders]
    _staged[:] = [name for name in _staged if name not in gone]
    delete(df.sparkSession, gone)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster on which it is not installed."""
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tapelab-"), "tapelab.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)


def default_parts(spark: SparkSession) -> int:
    """How many ordered buckets to cut: follows the session's shuffle width."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 65_536))
