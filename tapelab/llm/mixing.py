"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: a share of all words by weight, but at most ``max_repeats`` times a source's words; what
is above goes to the others by weight until none is above. That end state is a water level: with
sources sorted by capacity / weight, the first ones are full and the others get level x weight.

Sampling: a source is first taken whole as often as its target allows (complete epochs); the rest
goes to documents in the order of their keys -ln(u) / quality, u a hash of (seed, doc_id), until
the budget is used up. The document at the edge is taken in part. Order within a source comes
from a prefix sum in two steps: keys are cut into buckets at their own quantiles (and sizes, where one key has many
rows), so a source with a third of all rows, good or bad, with or without ids, is spread over many tasks; a
bucket is summed, the sums of buckets are added up, one row per source and bucket, and a running
sum inside the bucket completes it.

Quality is a column of 0 to 1 if one is named, such as a classifier's score; else the share of
lower-case letters and characters beyond ASCII stands in for it.

Defined results. Null text has size 0; sizes of 0 take nothing. A null source is a source, last
in order. Rows with the same doc_id have the same key and are told apart by size only. No rows: none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.operators.ordered import BUCKET, bucketed
from tapelab.session import default_parts, small, stage

WEIGHTS = (5, 2, 1)
BUCKETS_PER_TASK = 4
_U = 1 << 48


def words(text) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality(text) -> Column:
    """Share of lower-case ASCII letters and of anything beyond ASCII, from 0.1 to 1.1."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.length(t) - F.length(F.regexp_replace(t, r"[a-z\x{80}-\x{10FFFF}]+", ""))
    return F.lit(0.1) + F.when(F.length(t) == 0, F.lit(0.0)).otherwise(plain.cast("double") / F.length(t))


def uniform(doc_id, seed: int) -> Column:
    """In (0, 1], the same for a doc_id whenever and wherever it is asked for."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("long") + 1).cast("double") / F.lit(float(_U))


def targets(sources: DataFrame, share: float, max_repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (source, source_size; one row each) with weight and target."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sources.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
                              .cast("double").alias("weight"))
    # from the fullest: capacity per weight, then by name for a fixed order
    by_fill = Window.orderBy((F.col("source_size") * max_repeats / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    capacity = (F.col("source_size") * max_repeats).cast("double")
    level = ((F.sum("source_size").over(everywhere) * share - F.coalesce(F.sum(capacity).over(before), F.lit(0.0)))
             / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    stepped = weighted.select("*", capacity.alias("capacity"), level.alias("level"))
    full = F.col("capacity") < F.col("level") * F.col("weight")
    return stepped.select("source", "source_size", "weight", F.when(full, F.col("capacity")).otherwise(
        F.least("capacity", F.max(F.when(~full, F.col("level"))).over(everywhere) * F.col("weight"))).alias("target"))


def sample(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 11,
           buckets: int | None = None, quality_column: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source)."""
    good = F.lit(0.1) + F.greatest(F.coalesce(F.col(quality_column).cast("double"), F.lit(0.0)), F.lit(0.0)) if quality_column else quality("text")
    sized = stage(docs.select("doc_id", "source", words("text").alias("size"), good.alias("quality"))
                  .withColumn("key", -F.log(uniform("doc_id", seed)) / F.col("quality")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")),
                      share, max_repeats, weights)
    goal = stage(sources.select(F.col("source").alias("_source"), "source_size", "target",
                                F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"))
                 .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    # any cuts along the keys give the same result
    keyed = bucketed(sized, ["key", "size"], buckets or BUCKETS_PER_TASK * default_parts(docs.sparkSession)).withColumnRenamed(BUCKET, "bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = (keyed.groupBy(F.col("source").alias("_s"), F.col("bucket").alias("_b")).agg(F.sum("size").alias("total"))
            .select("_s", "_b", F.coalesce(F.sum("total").over(along), F.lit(0)).alias("base")))
    placed = (keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
              .join(small(goal), F.col("source").eqNullSafe(F.col("_source"))))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("within")))
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows of ``docs``: each document once per whole copy, the last copy cut after its words if it is in part.

    Rows that share doc_id, source and size all get the largest share among them.
    """
    taken = sample(docs, **options).where(F.col("taken") > 0)
    taken = (taken.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"))
             .agg(F.max("taken").alias("_taken")))
    rows = docs.withColumn("_size", words("text")).join(
        taken, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words")))
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_taken - 1) div _size"))))
    left = F.col("_taken") - F.col("_copy") * F.col("_size")
    cut = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"^(?s:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), left.cast("string"), F.lit("}+")), F.lit(0))
    text = F.when(left >= F.col("_size"), F.col("text")).otherwise(cut)
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return copies.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    return sample(docs.select("doc_id", "text", "source")).drop("source")
