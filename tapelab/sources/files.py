"""Many small files below one folder, written and hashed by tasks.

Hadoop's local file system starts a process for every file it makes. A folder that every executor sees as a
mounted one is therefore reached by plain calls; other stores keep Spark's writers and readers.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.session import default_parts

PIECE = 8 << 20  # bytes of a file read at once


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as plain calls name it, if its store is a mounted one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(p).toUri().getPath() if store.getUri().getScheme() == "file" else None


def write_texts(rows: DataFrame, path: str) -> None:
    """Text files below ``path``; a row (folder, file, text) is a line, one task writes a folder.

    On a mounted store a file is ``<two digits>/<folder>/<file>``, elsewhere ``folder=<folder>/file=<file>/part-*``.
    """
    spark = rows.sparkSession
    top, rows = mounted(spark, path), rows.repartition(default_parts(spark), "folder")
    if top is None:
        rows.select("folder", "file", F.col("text").alias("value")).write.partitionBy("folder", "file").text(path)
        return
    lines = F.concat(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n"), F.lit("\n"))
    group = F.lpad(F.lower(F.hex(F.pmod(F.xxhash64("folder"), F.lit(256)))), 2, "0")
    files = rows.groupBy("folder", "file").agg(lines.alias("text")).withColumn("group", group)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, work = 0, uuid.uuid4().hex
        for b in batches:
            for at, folder, file, text in zip(*(b.column(c).to_pylist() for c in ("group", "folder", "file", "text"))):
                home = f"{top}/{at}/{folder}"
                try:
                    os.mkdir(home)
                except FileExistsError:
                    pass
                except FileNotFoundError:
                    os.makedirs(home, exist_ok=True)
                with open(f"{home}/.{file}-{work}", "wb") as out:
                    out.write(text.encode())
                os.replace(f"{home}/.{file}-{work}", f"{home}/{file}")  # a task that is repeated leaves whole files
                done += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    os.makedirs(top, exist_ok=True)
    files.select("group", "folder", "file", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _seen(name: str) -> bool:
    """Spark's rule of which names a reader takes."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def hashes_below(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, bytes, sha256) of all files below a folder of a mounted store; None if ``path`` is no such folder.

    The driver sees the names right below the folder; tasks list what lies under them and read the files in pieces.
    """
    top = None if re.search(r"[*?{}\[\]]", path) else mounted(spark, path)
    if top is None or not os.path.isdir(top):
        return None

    def files(at: str) -> Iterator[str]:
        if not os.path.isdir(at):
            yield at
            return
        for folder, inner, names in os.walk(at):
            inner[:] = [n for n in inner if _seen(n)]
            yield from (f"{folder}/{n}" for n in names if _seen(n))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                for f in files(f"{top}/{name}"):
                    h, n = hashlib.sha256(), 0
                    with open(f, "rb") as source:
                        while piece := source.read(PIECE):
                            h.update(piece)
                            n += len(piece)
                    rows.append((f"file:{f}", n, h.hexdigest()))
                cells = zip(*rows) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.string(), pa.int64(), pa.string()))], ["path", "bytes", "sha256"])

    names = sorted(n for n in os.listdir(top) if _seen(n))
    units = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 4 * default_parts(spark))))
    return units.mapInArrow(hashed, "path string, bytes bigint, sha256 string")
