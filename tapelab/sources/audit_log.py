"""Append-only audit logs with insert-if-absent, duplicate repair and key upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The logs and how long a claimed key is kept.
KINDS = ("operacion", "evento", "rebalanceo", "oportunidad", "auditoria", "ejecucion")
KEY_DAYS = 180
KEY_BUCKETS = 64
FEW = 1000  # ids that a filter names one by one
KEY_SCHEMA = "kind string, bucket int, id string, claimed_at timestamp"
COLUMNS = ["kind", "id", "time", "route", "type", "decision", "payload"]
SCHEMA = "kind string, id string, time timestamp, route string, type string, decision string, payload string, date date"


def log_rows(df: DataFrame, kind: str, id_, time, route=None, type_=None, decision=None) -> DataFrame:
    """Rows of one log: typed key columns plus the whole row as JSON text."""
    payload = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(kind).alias("kind"), id_.cast("string").alias("id"), time.alias("time"), (none if route is None else route).alias("route"),
        (none if type_ is None else type_).alias("type"), (none if decision is None else decision).alias("decision"), payload.alias("payload"))


def unclaimed(new: DataFrame, keys: DataFrame) -> DataFrame:
    """First row of every (kind, id) that was never written before."""
    w = W.partitionBy("kind", "id").orderBy("time", F.xxhash64("payload"))
    first = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.join(keys.select("kind", "id"), ["kind", "id"], "left_anti")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log table; empty before the first append. Filters on kind and date prune partitions."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("kind", "id"), F.lit(KEY_BUCKETS)).cast("int")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys claimed in the log at ``path``. Filters on kind and bucket prune partitions."""
    try:
        return spark.read.schema(KEY_SCHEMA).parquet(f"{path}/_keys")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], KEY_SCHEMA)


def _write_keys(keys: DataFrame, path: str, name: str = "_keys") -> None:
    """Sorted by id, with Bloom filters per row group, so that few ids read few row groups."""
    keys = keys.select("kind", "id", "claimed_at", _bucket().alias("bucket")).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "id")
    out = keys.write.mode("append").option("parquet.bloom.filter.enabled#id", "true").option("parquet.block.size", 8 << 20)
    out.partitionBy("kind", "bucket").parquet(f"{path}/{name}")


def _place(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _settle(spark: SparkSession, path: str) -> None:
    """Ends a purge that was cut off: the old keys stand until the kept ones are all written, then those replace them."""
    fs, old = _place(spark, f"{path}/_keys")
    _, kept = _place(spark, f"{path}/_keys-kept")
    if fs.exists(kept):
        if fs.exists(old):
            fs.delete(kept, True)
        else:
            fs.rename(kept, old)


def append(new: DataFrame, path: str) -> None:
    """Idempotent append: a repeated call with the same rows writes nothing.

    Keys are looked up in a table beside the log (``_keys``, which readers of the log skip), of
    which only the kinds and hash buckets of the new rows are read, and of a batch with up to FEW ids
    only the row groups that may hold them; dates do not matter, and
    only ``purge`` lets a key go. A file ``_open`` stands while rows and keys are written: if it
    is found, or a log has no keys yet, the keys missing are first taken from the whole log. One
    writer per log is assumed, as plain Parquet has no transactions; a stream sink has one writer
    by construction.
    """
    spark = new.sparkSession
    seen = new.agg(F.collect_set("kind").alias("kinds"), F.collect_set(_bucket()).alias("buckets")).first()
    if not seen["kinds"]:
        return
    _settle(spark, path)
    fs, mark = _place(spark, f"{path}/_open")
    if fs.exists(mark) or fs.exists(mark.getParent()) and not fs.exists(_place(spark, f"{path}/_keys")[1]):
        _write_keys(seed_keys(read_log(spark, path)).join(read_keys(spark, path).select("kind", "id"), ["kind", "id"], "left_anti"), path)
    keys = read_keys(spark, path).where(F.col("kind").isin(seen["kinds"]) & F.col("bucket").isin(seen["buckets"]))
    few = [r["id"] for r in new.select("id").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW and None not in few:
        keys = keys.where(F.col("id").isin(few))
    rows = unclaimed(new, keys).withColumn("date", F.to_date("time"))
    fs.create(mark, True).close()
    rows.write.mode("append").partitionBy("kind", "date").parquet(path)
    _write_keys(seed_keys(new).join(keys.select("kind", "id"), ["kind", "id"], "left_anti"), path)
    fs.delete(mark, False)


def purge(spark: SparkSession, path: str, now, days: int = KEY_DAYS) -> None:
    """``purge_keys`` on the keys of the log at ``path``; no append may run meanwhile."""
    _settle(spark, path)
    _write_keys(purge_keys(read_keys(spark, path).drop("bucket"), read_log(spark, path), now, days), path, "_keys-kept")
    fs, kept = _place(spark, f"{path}/_keys-kept")
    if not fs.exists(kept):  # no key is kept
        fs.mkdirs(kept)
    fs.delete(_place(spark, f"{path}/_keys")[1], True)
    _settle(spark, path)


def repair_duplicates(log: DataFrame) -> DataFrame:
    """First observation per id: earliest time, then a fixed hash order."""
    w = W.partitionBy("kind", "id").orderBy("time", F.xxhash64("payload"))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def seed_keys(log: DataFrame) -> DataFrame:
    """Distinct keys with the first time they were seen."""
    return log.groupBy("kind", "id").agg(F.min("time").alias("claimed_at"))


def purge_keys(keys: DataFrame, log: DataFrame, now, days: int = KEY_DAYS) -> DataFrame:
    """Drop keys older than ``days`` that no row of the log uses any more."""
    old = F.col("claimed_at") < now - F.make_dt_interval(F.lit(days))
    kept = keys.where(old).join(log.select("kind", "id"), ["kind", "id"], "left_semi")
    return keys.where(~old).unionByName(kept)


class ParquetSink:
    """Default audit sink. Others offer the same ``write(df)``."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: DataFrame) -> None:
        append(rows, self.path)


SINKS: dict[str, Callable] = {"parquet": ParquetSink}


def register_sink(name: str, factory: Callable) -> None:
    SINKS[name] = factory


def sink(name: str, *args):
    return SINKS[name](*args)
