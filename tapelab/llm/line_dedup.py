"""Line deduplication with two Bloom filters.

A first scan puts the hash of every line key into a *once* filter and, if it was there already,
into a *twice* filter. Filters of different tasks are merged in a tree: a bit set in the *once*
filters of two tasks is set in *twice*. The merged *twice* filter (at most ``MAX_BITS`` bits) is
broadcast. A second scan sends only hashes found in it through a shuffle, which counts documents
exactly and finds the document that keeps the line. The few lines that hold more than a thousandth of
these hashes each are then broadcast with their keepers, the others joined by shuffle. False positives cost shuffle, never results:
when the filter is full, every long line's hash is shuffled, still without its text.

Defined results. Null text counts as empty (one empty line). Lines shorter than ``min_chars``
always stay. A null doc_id is one document, smaller than all others. Rows of one doc_id are one
document; each row is cut on its own. Line keys are compared by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm.batches import sliced
from tapelab.session import stage

SPACE = b" \t\n\x0b\x0c\r"
MAX_BITS = 1 << 28  # 32 MB a filter
CHUNK = 1 << 16  # bytes of filter in one row
FAN_IN = 64
HASHES = 3
HEAVY = 1000  # lines


def _key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() touches A-Z only


def _long(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(text: bytes | None, min_chars: int) -> set[bytes]:
    return {_hash(k) for k in set(map(_key, (text or b"").split(b"\n"))) if _long(k, min_chars)}


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit numbers of each hash (n x 2 words) under every hash function."""
    return [((h[:, 0] + np.uint64(i) * (h[:, 1] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64) for i in range(HASHES)]


def _has(filt: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([(filt[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0 for p in places])


def _put(filt: np.ndarray, places: list[np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(filt, p >> 3, (1 << (p & 7)).astype(np.uint8))


def _builder(bits: int, min_chars: int):
    def run(batches):
        from pyspark import TaskContext

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in sliced(batches):
            found = [d for t in b.column("text").to_pylist() for d in _digests(t, min_chars)]
            if not found:
                continue
            h, n = np.unique(np.frombuffer(b"".join(found), "<u8").reshape(-1, 2), axis=0, return_counts=True)
            places = _places(h, bits)
            again = (n > 1) | _has(once, places)
            _put(twice, [p[again] for p in places])
            _put(once, places)
        slot = TaskContext.get().partitionId()
        for c in range(0, len(once), CHUNK):
            o, t = once[c:c + CHUNK], twice[c:c + CHUNK]
            if o.any():
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([c // CHUNK], pa.int32()), "slot": pa.array([slot], pa.int32()),
                    "once": pa.array([zlib.compress(o.tobytes(), 1)]), "twice": pa.array([zlib.compress(t.tobytes(), 1)])})

    return run


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for o, t in zip(rows["once"], rows["twice"]):
        o, t = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(t), np.uint8)
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return pd.DataFrame({"chunk": [key[0]], "slot": [key[1]], "once": [zlib.compress(once.tobytes(), 1)],
                         "twice": [zlib.compress(twice.tobytes(), 1)]})


def repeated_filter(docs: DataFrame, text: str = "text", min_chars: int = 20, max_bits: int = MAX_BITS) -> np.ndarray:
    """The merged *twice* filter over the line keys of ``docs``."""
    texts = docs.select(F.col(text).cast("binary").alias("text"))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = max(8 * CHUNK, min(max_bits, 1 << int(16 * lines).bit_length()))
    schema = "chunk int, slot int, once binary, twice binary"
    rows = texts.mapInArrow(_builder(bits, min_chars), schema)
    slots = rows.rdd.getNumPartitions()
    while slots > 1:
        slots = -(-slots // FAN_IN)
        rows = rows.withColumn("slot", F.expr(f"slot div {FAN_IN}").cast("int")).groupBy("chunk", "slot").applyInPandas(_merge, schema)
    twice = np.zeros(bits // 8, np.uint8)
    for r in rows.select("chunk", "twice").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
        twice[r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(part)] = part
    return twice


def _suspects(shared, min_chars: int):
    def run(batches):
        twice = shared.value
        bits = len(twice) * 8
        for b in sliced(batches):
            ids, found = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                d = _digests(t, min_chars)
                ids += [i] * len(d)
                found += d
            if found:
                h = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
                hit = np.flatnonzero(_has(twice, _places(h, bits)))
                if len(hit):
                    s = h.view(np.int64)[hit]
                    yield pa.RecordBatch.from_pydict({
                        "h1": s[:, 0].copy(), "h2": s[:, 1].copy(), "doc_id": pa.array([ids[k] for k in hit], b.schema.field("doc_id").type)})

    return run


def _cutter(names: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n_lines, n_dropped, kept = [], [], []
            for t, drops in zip(b.column("_text").to_pylist(), b.column("_drops").to_pylist()):
                lines = (t or b"").split(b"\n")
                n_lines.append(len(lines))
                if drops:
                    gone = {np.array([d["h1"], d["h2"]], "<i8").tobytes() for d in drops}
                    lines = [x for x in lines if _hash(_key(x)) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), texts],
                names=[*names, "n_lines", "n_dropped", "kept_text"])

    return run


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3,
                max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without its text, with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A key of ``min_chars`` code points or more that stands in ``min_docs`` documents or more loses
    its lines everywhere but in the largest doc_id that holds it. Columns of the new names are replaced.
    """
    new = ["n_lines", "n_dropped", "kept_text"]
    docs = docs.drop(*(c for c in [*new, "_text", "_drops", "_id"] if c not in (text, doc_id)))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, text, min_chars, max_bits))
    id_type = docs.schema[doc_id].dataType
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        _suspects(shared, min_chars),
        T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc_id", id_type)]))
    suspects = stage(found.distinct())
    repeated = stage(suspects.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("_keeper")).where(F.col("n") >= min_docs))
    # a line in more than one of HEAVY suspects is heavy: at most HEAVY of them, so they can go to the rows
    heavy = F.broadcast(repeated.where(F.col("n") * HEAVY > suspects.count()))
    rest = suspects.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti").join(repeated, ["h1", "h2"])
    drops = (suspects.join(heavy, ["h1", "h2"]).unionByName(rest).where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
             .groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("_drops")))
    names = [c for c in docs.columns if c != text]
    joined = (docs.withColumn("_text", F.col(text).cast("binary")).join(drops, F.col(doc_id).eqNullSafe(F.col("_id")), "left")
              .select(*names, "_text", "_drops"))
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_cutter(names), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
