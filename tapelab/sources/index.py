"""Corpus index: five Parquet tables, one partition per corpus, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PAGE = 500
TABLES = ("corpus", "shard", "exchange_count", "shard_exchange", "shard_pair")


def index_tables(shards: DataFrame, corpus_sha256: str, generated_at) -> dict[str, DataFrame]:
    """The index of one corpus from its shards (shard, started, ended, venues, pairs, by_venue, ...)."""
    s = shards.withColumn("corpus_sha256", F.lit(corpus_sha256))
    return {
        "corpus": s.groupBy("corpus_sha256").agg(F.count("*").alias("shards"), F.sum("events").alias("events")).withColumn("generated_at", generated_at),
        "shard": s.drop("by_venue"),
        "exchange_count": s.select("corpus_sha256", F.explode("by_venue").alias("venue", "n")).groupBy("corpus_sha256", "venue").agg(F.sum("n").alias("events")),
        "shard_exchange": s.select("corpus_sha256", F.col("sha256").alias("shard_sha256"), F.explode("venues").alias("venue")),
        "shard_pair": s.select("corpus_sha256", F.col("sha256").alias("shard_sha256"), F.explode("pairs").alias("pair")),
    }


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the corpus' partitions only; writing the same corpus twice changes nothing."""
    for name, df in tables.items():
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_sha256").parquet(f"{path}/{name}"))


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def query_index(
    tables: dict[str, DataFrame], corpus: str | None = None, venue: str | None = None, pair: str | None = None,
    started_from: int | None = None, ended_to: int | None = None, after: tuple[int, str] | None = None, limit: int = 100,
) -> DataFrame:
    """One page of shards ordered by (started, sha256), with ``has_more``.

    Filters by link tables are semi-joins. ``after`` is the last (started, sha256) of the previous
    page. Without ``corpus`` the newest one is taken.
    """
    limit = max(1, min(limit, MAX_PAGE))
    s = tables["shard"]
    if corpus is None:
        top = tables["corpus"].agg(F.max(F.struct("generated_at", "corpus_sha256"))["corpus_sha256"].alias("_c"))
        s = s.join(F.broadcast(top), F.col("corpus_sha256") == F.col("_c")).drop("_c")
    else:
        s = s.where(F.col("corpus_sha256") == corpus)
    for table, column, value in (("shard_exchange", "venue", venue), ("shard_pair", "pair", pair)):
        if value is not None:
            link = tables[table].where(F.col(column) == value).select("corpus_sha256", F.col("shard_sha256").alias("sha256"))
            s = s.join(link, ["corpus_sha256", "sha256"], "left_semi")
    if started_from is not None:
        s = s.where(F.col("started") >= started_from)
    if ended_to is not None:
        s = s.where(F.col("ended") <= ended_to)
    if after is not None:
        t, h = after
        s = s.where((F.col("started") > t) | ((F.col("started") == t) & (F.col("sha256") > h)))
    page = s.orderBy("started", "sha256").limit(limit + 1)
    # the page is at most 501 rows
    n = page.agg(F.count("*").alias("_n"))
    page = page.orderBy("started", "sha256").limit(limit)
    return page.join(F.broadcast(n)).withColumn("has_more", F.col("_n") > limit).drop("_n")
