"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are reduced to (doc_id, digest, length) rows in one scan. Misra-Gries counters (Spark's
``freqItems``) name every digest held by more than ``support`` of all rows, and maybe others; an
exact aggregation over those few digests verifies them and finds their winners, which are
broadcast: at most ``1 / support`` rows. Heavy rows meet their winner on the map side. The
remaining digests, none above that share, go through an ordinary shuffle.

Defined results. Null text counts as empty, so null and blank texts are one group. A null doc_id
is larger than any other when lengths tie. Rows repeated with the same doc_id: the group counts
each row, and one of them is kept. No rows: no rows. Other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelab.session import stage

SUPPORT = 1 / 1024


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.length(t).alias("chars"), F.sha2(plain.cast("binary"), 256).alias("text_sha256"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = stage(digests(docs, text, doc_id).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("chars"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("last_id"), F.bitwise_not("row").alias("last_row"))
    candidates = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("_digest")).distinct()
    heavy = (rows.join(F.broadcast(candidates), F.col("text_sha256") == F.col("_digest"), "left_semi").groupBy("text_sha256")
             .agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best")))
    winners = stage(heavy.where(F.col("group_size") > 1))  # bounded by the number of counters
    best = F.col("best")
    marked = rows.join(F.broadcast(winners.withColumnRenamed("text_sha256", "_digest")), F.col("text_sha256") == F.col("_digest"), "left")
    w = Window.partitionBy("text_sha256")
    light = (rows.join(F.broadcast(winners.select(F.col("text_sha256").alias("_digest"))), F.col("text_sha256") == F.col("_digest"), "left_anti")
             .select("*", F.count(F.lit(1)).over(w).alias("group_size"), F.max(order).over(w).alias("best")))
    out = marked.where(F.col("_digest").isNotNull()).select(*light.columns).unionByName(light)
    return out.select("doc_id", F.bitwise_not(best["last_id"]).alias("keep_id"), "group_size", (F.col("row") == F.bitwise_not(best["last_row"])).alias("kept"), "text_sha256")
