"""Ledger files: one JSON document per ledger, or JSON lines with a hash chain."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelab.sources.schemas import EVENT_FIELDS, LEDGER, LEDGER_TEXT


def read_ledgers(spark: SparkSession, path) -> DataFrame:
    """One row per ledger document, amounts as DECIMAL(38,18)."""
    d = spark.read.schema(LEDGER).option("multiLine", "true").json(path)
    return d.select(F.col("_metadata.file_path").alias("ledger"), "*")


def read_ledger_texts(spark: SparkSession, path) -> DataFrame:
    """One row per ledger document, amounts of events as the text they have in the file."""
    d = spark.read.schema(LEDGER_TEXT).option("multiLine", "true").json(path)
    return d.select(F.col("_metadata.file_path").alias("ledger"), "*")


def ledger_events(docs: DataFrame) -> DataFrame:
    """One row per event with its position in the document."""
    return docs.select("ledger", F.posexplode("events").alias("position", "e")).select("ledger", "position", "e.*")


def read_jsonl_ledger(spark: SparkSession, path) -> DataFrame:
    """Hash-chained lines; the payload text stays byte-exact, as the hash covers it."""
    lines = spark.read.text(path)
    at = lambda f: F.get_json_object("value", f"$.{f}")
    payload = F.regexp_extract("value", r'"payload":(.*),"previousHash":', 1)
    return lines.select(
        F.col("_metadata.file_path").alias("ledger"), at("sequence").cast("bigint").alias("sequence"), at("timestamp").alias("timestamp"),
        at("event").alias("event"), payload.alias("payload"), at("previousHash").alias("previous"), at("hash").alias("hash"))


def line_hash() -> Column:
    """SHA-256 of the JSON array [sequence, timestamp, event, payload, previous hash]."""
    quote = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    text = F.concat(F.lit("["), F.concat_ws(",", F.col("sequence").cast("string"), quote("timestamp"), quote("event"), F.col("payload"), quote("previous")), F.lit("]"))
    return F.sha2(text, 256)


def chained_hashes(genesis: str):
    """A function of an array of event texts with an empty ``previous_hash``: their hashes, each over the text with the hash before it."""

    @F.pandas_udf("array<string>")
    def hashes(texts: pd.Series) -> pd.Series:
        def chain(rows):
            out, head = [], genesis
            for text in rows:
                before, after = text.split('"previous_hash":"', 1)
                head = hashlib.sha256(f'{before}"previous_hash":"{head}{after}'.encode()).hexdigest()
                out.append(head)
            return out

        return texts.map(chain)

    return hashes


def _lower_escapes(text: Column) -> Column:
    """Escapes of control characters with small hex digits, which Spark writes in capitals."""
    out = text
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        # an even number of backslashes before it: the escape is not itself escaped
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(F.contains(text, F.lit("\\u00")), out).otherwise(text)


def event_text() -> Column:
    """The compact JSON that the hash of a document's event covers; null for an unknown type or a missing field.

    Input: events of :func:`read_ledger_texts`. Amounts are the text of the file, so ``"1.50"`` and ``"1.5"`` differ.
    """
    c = F.col
    out = F.lit(None).cast("string")
    for kind, fields in EVENT_FIELDS.items():
        whole = F.lit(True)
        for f in ("id", "sequence", "previousHash", *fields):
            whole = whole & c(f).isNotNull()
        data = F.struct(c("type"), *[c(f) for f in fields])
        text = F.to_json(F.struct(c("id"), c("sequence"), c("previousHash").alias("previous_hash"), data.alias("data")))
        out = F.when((c("type") == kind) & whole, text).otherwise(out)
    return _lower_escapes(out)
