"""A corpus pipeline of five stages over ``documents``: language, lines, near duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet into the shared folder, hands the reread table to the next stage and deletes what has been
read. All but the last return the columns of their documents, further ones unchanged, whatever their
names; an empty table gives an empty one. Tokenization and language models have no SQL twin.
"""

from __future__ import annotations

from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.llm import language_id, line_dedup, mixing, ngram_join, packing, tokens
from tapelab.session import small, stage, staging, unstage

ORACLE_SQL = None
LEAST_SCORE = 0.5
MOST_MISFIT = 1.0


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(step):
    """``step`` with the further columns of docs under names that no operator uses, so that none is overwritten."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in COLUMNS else f"further column {i}" for i, c in enumerate(docs.columns)}
        out = step(spark, docs.select(*(F.col(f"`{c}`").alias(new) for c, new in names.items())), sf_dir)
        return out.select(*(F.col(new).alias(c) for c, new in names.items()))

    return run


@apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, whose language stays unsure or that are unlike it; ``lang`` of the others is left as it is."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    scored = language_id.predict(docs, model, keep_text=True, misfit=True)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("misfit") <= MOST_MISFIT))


@apart
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; documents stay, if need be with an empty text."""
    out = line_dedup.dedup_lines(docs).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with its file's hash and row number there, the same at every read; what is no table of files is written first."""
    try:
        at = docs.select("*", F.xxhash64("_metadata.file_path").alias("row file"), F.col("_metadata.row_index").alias("row number"))
    except AnalysisException:
        return _row_key(stage(docs))
    return at


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by a Jaccard similarity of 0.8 of five-word shingles one row stays, that of the smallest doc_id, nulls last.

    The rows that go are kept with their places only and taken out as ``docs`` is read again.
    """
    rows = _row_key(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "`row file`", "`row number`")  # ids may be null or repeated
    with staging(spark) as keep:
        groups = ngram_join.group(rows.select(place.alias("place"), "text"), k=5, num=80, den=100, doc_id="place")
        gone = keep(groups.where("doc_id != component_id").select("doc_id.`row file`", "doc_id.`row number`"))
    return rows.join(small(gone), ["row file", "row number"], "left_anti").select(*docs.columns)


@apart
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the sources' weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 token ids."""
    return packing.digest(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        with staging(spark) as keep:
            done = keep(step(spark, docs, sf_dir))
        unstage(docs)  # it has been read
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
