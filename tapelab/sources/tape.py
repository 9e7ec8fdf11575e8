"""Recorded tapes, quote files and corpora."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapelab.sources.files import hashes_below
from tapelab.sources.schemas import CAPTURE, MANIFEST, MANIFEST_DEFAULTS, QUOTE, QUOTE_DOC, TAPE

QUARANTINE = "failed-"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _levels(name: str):
    return F.transform(name, lambda x: F.struct(x["precio"].alias("price"), x["cantidad"].alias("qty")))


def _folder(path: str) -> Column:
    """Name of a file's folder; a pattern tries every place of the path, which for a line costs as much as its JSON."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def canonical_events(raw: DataFrame) -> DataFrame:
    """Tape rows with library names, defaults for missing keys and times in microseconds."""
    i = F.col("integrity")
    keep = [c for c in ("shard", "block_start", "row_id") if c in raw.columns]
    return raw.select(
        *keep, F.col("schemaVersion").alias("schema_version"), F.col("exchange").alias("venue"), "pair", "kind",
        F.unix_micros("localTimestamp").alias("t"), F.unix_micros("exchangeTimestamp").alias("exchange_t"),
        F.col("sequenceId").alias("sequence"), F.col("previousSequence").alias("previous"),
        _levels("bids").alias("bids"), _levels("asks").alias("asks"), F.col("source.type").alias("source"),
        i["status"].alias("status"), F.coalesce(i["gap"], F.lit(False)).alias("gap"),
        F.coalesce(i["resync"], F.lit(False)).alias("resync"), F.coalesce(i["connectionEpoch"], F.lit(0)).alias("epoch"),
        F.coalesce(i["reconnected"], F.lit(False)).alias("reconnected"),
        F.coalesce("observedLatencyMs", F.lit(0)).alias("latency_ms"),
    )


def read_tape(spark: SparkSession, path, mode: str = "FAILFAST") -> DataFrame:
    """Events of JSONL tapes with a recorded-order key (shard, block_start, row_id).

    A bad line stops the job; the error names the file. Large files are split; the key keeps the
    line order all the same, as Spark numbers rows along a split.
    """
    raw = spark.read.schema(TAPE).option("mode", mode).json(path)
    raw = raw.select("*", _folder("_metadata.file_path").alias("shard"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_id"))
    return canonical_events(raw)


def bad_lines(spark: SparkSession, path) -> DataFrame:
    """Lines that are not tape events: file and text, instead of an abort."""
    raw = spark.read.schema(TAPE + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), "_corrupt_record", "localTimestamp", "exchange")
    return raw.where("_corrupt_record IS NOT NULL OR localTimestamp IS NULL OR exchange IS NULL").select("file", F.col("_corrupt_record").alias("line"))


def numbered_bad_lines(spark: SparkSession, path) -> DataFrame:
    """Lines that are not tape events with their file, number in it (from 1, blank lines counted) and in how many pieces the file is read.

    A file may be read in several pieces. Of every piece only its first running id and its number of
    lines are gathered; a line's number follows from its own id, so no line is sorted or shuffled.
    """
    kind = StructType.fromDDL(TAPE + ", _corrupt_record string")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*place, "value", F.monotonically_increasing_id().alias("id"))
    pieces = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    w = Window.partitionBy("file").orderBy("block")  # a row per piece
    pieces = pieces.select("file", "block", "first", (F.sum("n").over(w) - F.col("n")).alias("before"), F.count("*").over(Window.partitionBy("file")).alias("pieces"))
    event = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = event.isNull() | event["_corrupt_record"].isNotNull() | event["localTimestamp"].isNull() | event["exchange"].isNull()
    found = lines.where((F.trim("value") != "") & bad).join(pieces, ["file", "block"])
    return found.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), F.col("value").alias("line"), "pieces")


def _quote(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("exchange").alias("venue"), F.col("par").alias("pair"), F.col("eventoUnixMs").alias("event_ms"), F.col("secuencia").alias("seq"),
        "bid", F.col("bidCantidad").alias("bid_qty"), "ask", F.col("askCantidad").alias("ask_qty"),
        F.coalesce(_levels("bids"), F.array().cast("array<struct<price:double,qty:double>>")).alias("bids"),
        F.coalesce(_levels("asks"), F.array().cast("array<struct<price:double,qty:double>>")).alias("asks"),
        F.unix_micros("recibidaEn").alias("t"), F.coalesce("latenciaMs", F.lit(0)).alias("latency_ms"),
        F.coalesce("integrityStatus", F.lit("")).alias("status"), F.coalesce("conectado", F.lit(False)).alias("connected"),
        F.coalesce("ultimoMensaje", F.lit("")).alias("last_message"),
    )


def read_quotes(spark: SparkSession, path: str, lines=("*.jsonl", "*.ndjson"), documents: str = "*.json") -> DataFrame:
    """Quotes from JSON lines (.jsonl, .ndjson) and JSON documents (.json) below ``path``; other names by argument.

    A document is an array of quotes or an object with them in ``cotizaciones`` or ``eventos``.
    Only documents must be read whole by one task; lines are split. Sort by (event_ms, seq) at the
    edge where an order is needed.
    """
    opt = {"recursiveFileLookup": "true"}
    parts = []
    for glob in lines:
        parts.append(_quote(spark.read.schema(QUOTE).options(**opt, pathGlobFilter=glob, mode="FAILFAST").json(path)))
    parts.append(from_documents(read_documents(spark, path, documents)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """JSON documents (.json) below ``path``, one per file; anything after the document is an error.

    A JSON reader in multi-line mode drops what follows the first value, so the text is read whole
    and must parse as one value: an object, or an array of quotes.
    """
    files = spark.read.options(recursiveFileLookup="true", pathGlobFilter=glob).text(path, wholetext=True)
    value = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    # [{..}] is put into the wrapper form; a second value behind the first breaks the wrapper
    wrapped = F.when(F.startswith(value, F.lit("[")), F.concat(F.lit('{"cotizaciones":'), value, F.lit("}"))).otherwise(
        F.when(F.startswith(value, F.lit("{")), F.concat(F.lit('{"cotizaciones":null,"all":['), value, F.lit("]}"))).otherwise(value))
    inside = f"cotizaciones array<struct<{QUOTE}>>, all array<struct<{QUOTE_DOC}>>"
    parsed = files.select(F.from_json(wrapped, inside, {"mode": "FAILFAST"}).alias("d"))
    lone = parsed.where("d.all IS NOT NULL").select(F.inline("d.all"))
    arrays = parsed.where("d.cotizaciones IS NOT NULL").select("d.cotizaciones")
    return lone.unionByName(arrays, allowMissingColumns=True)


def from_documents(doc: DataFrame) -> DataFrame:
    """Quotes of parsed documents: rows of an array, or rows inside a wrapper object."""
    inner = F.coalesce("cotizaciones", "eventos")
    plain = _quote(doc.where(inner.isNull()).drop("cotizaciones", "eventos"))
    return plain.unionByName(_quote(doc.where(inner.isNotNull()).select(F.inline(inner))))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of the corpus' shards (direct child folders); quarantined shards are skipped."""
    m = spark.read.schema(MANIFEST).option("multiLine", "true").json(f"{root}/*/manifest.json")
    m = m.select("*", _folder("_metadata.file_path").alias("shard"))
    m = m.where(~F.col("shard").startswith(QUARANTINE))
    return m.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in MANIFEST_DEFAULTS.items()})


def read_capture_configs(spark: SparkSession, root: str) -> DataFrame:
    c = spark.read.schema(CAPTURE).option("multiLine", "true").json(f"{root}/*/capture-config.json")
    return c.select("*", _folder("_metadata.file_path").alias("shard")).where(~F.col("shard").startswith(QUARANTINE))


def read_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, events) of a corpus; an empty corpus is an error."""
    manifests = read_manifests(spark, root)
    if manifests.isEmpty():
        raise ValueError("the corpus holds no shard with a manifest")
    return manifests, read_shard_events(spark, root)


def read_shard_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of all shards with a manifest; quarantine is filtered by folder name on the scan."""
    return read_tape(spark, f"{root}/*/events.jsonl").where(~F.col("shard").startswith(QUARANTINE))


def file_hashes(spark: SparkSession, paths) -> DataFrame:
    """SHA-256 and size of whole files (each file is one row, so shards stay below 2 GB).

    Of a folder all files below it; its folders are listed by tasks, those of a pattern by the driver.
    On a mounted store tasks list and read a folder's files themselves.
    """
    found = hashes_below(spark, paths) if isinstance(paths, str) else None
    if found is not None:
        return found
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tape_rows(quotes: DataFrame, *more: str) -> DataFrame:
    """Quotes with levels in the recorded tape layout (used by writers and replays); ``more`` columns stay."""
    def lv(name):
        return F.transform(name, lambda x: F.struct(x["price"].alias("precio"), x["qty"].alias("cantidad")))

    has = set(quotes.columns)
    kind = F.col("kind") if "kind" in has else F.lit("snapshot")
    return quotes.select(
        *more, F.lit(1).alias("schemaVersion"), F.timestamp_micros("t").alias("localTimestamp"), F.col("venue").alias("exchange"), "pair",
        F.struct(F.lit("web_socket").alias("type"), F.lit("").alias("url")).alias("source"), kind.alias("kind"), F.col("seq").alias("sequenceId"),
        lv("bids").alias("bids"), lv("asks").alias("asks"),
        F.struct(F.lit("ok").alias("status"), F.lit(False).alias("gap"), F.lit(False).alias("resync")).alias("integrity"),
        F.col("latency_ms").cast("bigint").alias("observedLatencyMs"),
    )


def write_tape(quotes: DataFrame, path: str, by: str | None = None) -> None:
    """Append quotes or book messages as JSON lines with microsecond times, in a folder per value of ``by`` if given."""
    out = tape_rows(quotes, *([by] if by else [])).write.mode("append").option("timestampFormat", TIME_FORMAT)
    (out.partitionBy(by) if by else out).json(path)


def publish_in_order(spark: SparkSession, work: str, path: str) -> None:
    """Moves the files of the folders ``<name>=<number>`` in ``work`` to ``path``; their times rise with the number.

    A folder source takes files by time. The driver sees one name per file.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in fs.listStatus(at(work)) if "=" in f.getPath().getName()]
    folders.sort(key=lambda f: int(f.getName().split("=")[1]))
    files = [f.getPath() for folder in folders for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    first = int(time.time()) - len(files)
    for i, file in enumerate(files):
        name = at(f"{path}/{i:06d}-{file.getName()}")
        fs.setTimes(file, (first + i) * 1000, -1)
        if not fs.rename(file, name):
            raise OSError(f"{file} could not be renamed to {name}")
    fs.delete(at(work), True)


def event_rows(events: DataFrame, *more: str) -> DataFrame:
    """Canonical messages in the recorded tape layout, the inverse of :func:`canonical_events`; ``more`` columns stay."""
    def lv(name):
        return F.transform(name, lambda x: F.struct(x["price"].alias("precio"), x["qty"].alias("cantidad")))

    return events.select(
        *more, F.col("schema_version").alias("schemaVersion"), F.timestamp_micros("exchange_t").alias("exchangeTimestamp"), F.timestamp_micros("t").alias("localTimestamp"),
        F.col("venue").alias("exchange"), "pair", F.struct(F.col("source").alias("type"), F.lit("").alias("url")).alias("source"), "kind",
        F.col("sequence").alias("sequenceId"), F.col("previous").alias("previousSequence"), lv("bids").alias("bids"), lv("asks").alias("asks"),
        F.struct("status", "gap", "resync", F.col("epoch").alias("connectionEpoch"), "reconnected").alias("integrity"), F.col("latency_ms").alias("observedLatencyMs"))
