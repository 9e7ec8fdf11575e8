"""Packing by concatenate-and-cut.

All documents form one stream of ids. A first pass encodes them and notes, per task, how many ids
each document has before it; the sums of the tasks give the place of every task in the stream
(prefix sum), and so the place of every document, with no shuffle of ids. A second pass cuts the
stream into windows of fixed length; a document over a window's edge gives boundary records on
both sides. Only the last window can be short.

Defined results. Null text counts as empty: one end id. Rows repeat as often as they occur in the
input. Any doc_id, null too, is carried along. No rows: no windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm import tokens
from tapelab.llm.batches import sliced
from tapelab.session import stage

BATCH_BYTES = 8 << 20


def _encode(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        part, before, seq = TaskContext.get().partitionId(), 0, 0

        def flush(ids, counts, places, blobs):
            n = len(ids)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, kind), "part": pa.array([part] * n, pa.int32()), "before": pa.array(places, pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(blobs, pa.binary())})

        for b in sliced(batches):
            kind = b.schema.field("doc_id").type
            out, size = ([], [], [], []), 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                blob = enc.encode(t or "") + end
                n = len(blob) // enc.dtype.itemsize
                for x, v in zip(out, (i, n, before, blob)):
                    x.append(v)
                before += n
                size += len(blob)
                if size >= BATCH_BYTES:
                    yield flush(*out)
                    out, size = ([], [], [], []), 0
            if out[0]:
                yield flush(*out)

    return run


def _cut(path: str, window: int, with_ids: bool):
    def run(batches):
        dtype = tokens.encoder(path).dtype
        for b in sliced(batches):
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for i, base, n, blob in zip(*(b.column(c).to_pylist() for c in ("doc_id", "place", "n_tokens", "ids"))):
                ids, at = tokens.as_words(blob, dtype), 0
                while at < n:
                    seq, offset = divmod(base + at, window)
                    size = min(n - at, window - offset)
                    piece = ids[at:at + size]
                    for k, v in zip(cols, (i, at, size, tokens.crc(piece), n, seq, offset, piece.astype("<u4").tobytes() if with_ids else None)):
                        cols[k].append(v)
                    at += size
            kinds = {"doc_id": b.schema.field("doc_id").type, "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items() if with_ids or k != "ids"})

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = tokens.END_ID, text: str = "text",
         doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids (unsigned 32-bit)."""
    kind = docs.schema[doc_id].dataType
    encoded = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
                            T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(tokenizer, end_id), encoded))
    # one row per task: the only thing that is put into a single order
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("place"), "n_tokens", "ids")
    pieces = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in
                           ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    return placed.mapInArrow(_cut(tokenizer, window, with_ids), pieces)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer, with_ids=False)
