"""Token ids in wavelet-matrix files, one compressed file per shard.

Documents are range-partitioned and sorted by doc_id, so shards follow each other in id order.
Every shard file holds segments; a segment is a wavelet matrix: one bit-plane per bit of an id, most
significant first, in which ids with a 0 bit move stably before those with a 1 bit. With rank
counts per 512 bits it answers, without unpacking ids, what stands at a place (``access``), how
often an id occurs before a place (``rank``) and where its k-th occurrence is (``select``).

Layout of a segment (numbers little-endian): magic ``WMX1``; u8 bits; u8 id-index flag 0; u16 0;
u64 number of ids; u64 number of documents; then for each plane u64 zeros and u32 packed size; u32
packed size of the document lengths; the packed planes (bits, then u32 rank per 512 bits); the
packed lengths (u64 each). Packing is Zstandard. A Parquet file of the shard folder carries the
segments as ``file`` with the doc_ids and the number of ids before them in the shard beside them,
since Spark writes and reads those anywhere. ``count``, ``positions`` and ``access`` ask a whole folder.

Defined results. Null text counts as empty: its end id only. A null doc_id sorts first; rows with
equal doc_id follow each other in the order of (text length, text). No rows: no files, no rows; every
id then has count 0. A doc_id is a bigint, int or string.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm import tokens
from tapelab.llm.batches import sliced
from tapelab.session import staging_dir

BLOCK = 512
SEGMENT = 2_000_000
OPEN = 65_536  # occurrences looked up at a time
_HEAD = struct.Struct("<4sBBHQQ")
_PLANE = struct.Struct("<QI")
_ZSTD = pa.Codec("zstd", 1)


def build(ids: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    """A segment file of ``ids``, which belong to documents of the given ``lengths``."""
    head, bodies, seq = [_HEAD.pack(b"WMX1", bits, 0, 0, len(ids), len(lengths))], [], ids
    for level in range(bits - 1, -1, -1):
        bit = (seq & seq.dtype.type(1 << level)) != 0
        plane = np.packbits(bit, bitorder="little")
        blocks = -(-len(bit) // BLOCK)
        ones = np.zeros(blocks + 1, "<u4")
        padded = np.zeros(blocks * BLOCK // 8, np.uint8)
        padded[:len(plane)] = plane
        np.cumsum(np.bitwise_count(padded.view("<u8")).reshape(blocks, -1).sum(axis=1), out=ones[1:])
        zero = seq[~bit]
        body = _ZSTD.compress(padded.tobytes() + ones.tobytes(), asbytes=True)
        head.append(_PLANE.pack(len(zero), len(body)))
        bodies.append(body)
        seq = np.concatenate((zero, seq[bit]))
    tail = _ZSTD.compress(lengths.astype("<u8").tobytes(), asbytes=True)
    return b"".join([*head, struct.pack("<I", len(tail)), *bodies, tail])


class Segment:
    """Queries on one segment file."""

    def __init__(self, file: bytes):
        magic, self.bits, _, _, self.n, docs = _HEAD.unpack_from(file)
        if magic != b"WMX1":
            raise ValueError("not a wavelet-matrix segment")
        at, sizes, self.zeros = _HEAD.size, [], []
        for _ in range(self.bits):
            zeros, size = _PLANE.unpack_from(file, at)
            self.zeros.append(zeros)
            sizes.append(size)
            at += _PLANE.size
        tail = struct.unpack_from("<I", file, at)[0]
        at += 4
        blocks = -(-self.n // BLOCK)
        self.planes, self.ones = [], []
        for size in sizes:
            body = _ZSTD.decompress(file[at:at + size], blocks * BLOCK // 8 + 4 * (blocks + 1), asbytes=True)
            self.planes.append(np.frombuffer(body, np.uint8, blocks * BLOCK // 8))
            self.ones.append(np.frombuffer(body, "<u4", blocks + 1, blocks * BLOCK // 8))
            at += size
        self.lengths = np.frombuffer(_ZSTD.decompress(file[at:at + tail], 8 * docs, asbytes=True), "<u8", docs)

    def _rank1(self, level: int, at: int) -> int:
        block, rest = divmod(at, BLOCK)
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block * BLOCK + rest + 7) // 8], bitorder="little")[:rest]
        return int(self.ones[level][block]) + int(bits.sum())

    def access(self, at: int) -> int:
        """The id at a place."""
        out = 0
        for level in range(self.bits):
            bit = int(self.planes[level][at >> 3]) >> (at & 7) & 1
            one = self._rank1(level, at)
            at = self.zeros[level] + one if bit else at - one
            out = out << 1 | bit
        return out

    def _bounds(self, token: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id before a place, or in all."""
        if token >> self.bits:
            return 0
        a, b = self._bounds(token, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of an id, k from 0; -1 if there are fewer."""
        if token >> self.bits:
            return -1
        a, b = self._bounds(token, self.n)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th 0 or 1 of a plane."""
        ones = self.ones[level].astype(np.int64)
        counts = ones if bit else np.arange(len(ones), dtype=np.int64) * BLOCK - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def places(self, token: int) -> np.ndarray:
        """All places of an id, rising: its run in the last order carried back through the planes."""
        if token >> self.bits:
            return np.zeros(0, np.int64)
        a, b = self._bounds(token, self.n)
        at = np.arange(a, b, dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._find_all(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _find_all(self, level: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """The places of the k-th 0s or 1s of a plane for rising ``ks``; opens only their blocks, some at a time."""
        ones = self.ones[level].astype(np.int64)
        counts = ones if bit else np.arange(len(ones), dtype=np.int64) * BLOCK - ones
        plane, out = self.planes[level].reshape(-1, BLOCK // 8), []
        for some in np.array_split(ks, max(1, -(-len(ks) // OPEN))):
            block = np.searchsorted(counts, some, side="right") - 1
            rows, row = np.unique(block, return_inverse=True)
            hits = np.unpackbits(plane[rows], axis=1, bitorder="little") == bit
            line, place = np.nonzero(hits)  # in order of block and place
            first = np.searchsorted(line, np.arange(len(rows)))
            out.append(block * BLOCK + place[first[row] + some - counts[block]])
        return np.concatenate(out)

    def ids(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        seq = np.zeros(self.n, "<u4" if self.bits > 16 else "<u2")
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(seq)
            up[~bit] = seq[:self.zeros[level]]
            up[bit] = seq[self.zeros[level]:] | seq.dtype.type(1 << (self.bits - 1 - level))
            seq = up
        return seq


def _writer(path: str, end_id: int, kind: pa.DataType, segment: int):
    def run(batches):
        from pyspark import TaskContext

        enc = tokens.encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        shard, seg, size, before = TaskContext.get().partitionId(), 0, 0, 0
        ids, blobs = [], []

        def flush():
            lengths = np.array([len(b) // enc.dtype.itemsize for b in blobs], np.uint64)
            stream = np.frombuffer(b"".join(blobs), enc.dtype)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([seg], pa.int32()), "before": pa.array([before], pa.int64()),
                "n_tokens": pa.array([len(stream)], pa.int64()), "doc_ids": pa.array([ids], pa.list_(kind)), "file": pa.array([build(stream, lengths, 8 * enc.dtype.itemsize)], pa.binary())})

        for b in sliced(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                blobs.append(enc.encode(t or "") + end)
                ids.append(i)
                size += len(blobs[-1]) // enc.dtype.itemsize
                if size >= segment:
                    yield flush()
                    ids, blobs, seg, size, before = [], [], seg + 1, 0, before + size
        if ids:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = tokens.END_ID, shards: int | None = None,
          segment: int = SEGMENT, text: str = "text", doc_id: str = "doc_id") -> str:
    """Write the ids of all texts in ascending doc_id order into shard files below ``path``."""
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(*([shards] if shards else []), "doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("before", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("file", T.BinaryType())])
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    ordered.mapInArrow(_writer(tokenizer, end_id, arrow, segment), schema).write.option("compression", "none").parquet(path)
    return path


def _reader(batches):
    for b in batches:
        for ids, base, file in zip(b.column("doc_ids"), b.column("base").to_pylist(), b.column("file").to_pylist()):
            seg = Segment(file)
            stream, n = seg.ids(), seg.lengths.astype(np.int64)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.values, "start": pa.array(base + ends - n), "n_tokens": pa.array(n),
                "ids_crc32": pa.array([tokens.crc(stream[e - k:e]) for e, k in zip(ends, n)], pa.int64())})


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""
    files = spark.read.parquet(path)
    # one row per shard, so one per writing task
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    return files.join(F.broadcast(bases), "shard").select("doc_ids", (F.col("first") + F.col("before")).alias("base"), "file").mapInArrow(_reader, schema)


def count(spark, path: str, ids: list[int]) -> DataFrame:
    """token, n: how often each of ``ids`` occurs in all shards, by rank in the planes; an id that never occurs has 0.

    ``ids`` is the question, a list of the caller's; equal ids are asked once.
    """
    asked = sorted(set(ids))

    def run(batches):
        for b in batches:
            for file in b.column("file"):
                seg = Segment(file.as_py())
                yield pa.RecordBatch.from_pydict({"token": pa.array(asked, pa.int64()), "n": pa.array([seg.rank(t) for t in asked], pa.int64())})

    found = spark.read.parquet(path).select("file").mapInArrow(run, "token bigint, n bigint")
    none = spark.createDataFrame([(t, 0) for t in asked], "token bigint, n bigint")
    return found.unionByName(none).groupBy("token").agg(F.sum("n").alias("n"))


def positions(spark, path: str, ids: list[int]) -> DataFrame:
    """token, doc_id, at: every occurrence of ``ids`` in all shards, ``at`` counted in its document from 0."""
    asked = sorted(set(ids))
    files = spark.read.parquet(path).select("doc_ids", "file")
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("doc_id", kind), T.StructField("at", T.LongType())])

    def run(batches):
        for b in batches:
            for docs, file in zip(b.column("doc_ids"), b.column("file")):
                seg = Segment(file.as_py())
                ends = np.cumsum(seg.lengths.astype(np.int64))
                starts = ends - seg.lengths.astype(np.int64)
                for token in asked:
                    places = seg.places(token)
                    for some in np.array_split(places, max(1, -(-len(places) // OPEN))):
                        doc = np.searchsorted(ends, some, side="right")
                        yield pa.RecordBatch.from_pydict({
                            "token": pa.array(np.full(len(some), token, np.int64)), "doc_id": docs.values.take(pa.array(doc)), "at": pa.array(some - starts[doc])})

    return files.mapInArrow(run, schema)


def access(wanted: DataFrame, path: str) -> DataFrame:
    """token of every distinct (doc_id, at) of ``wanted``, read from the planes; null where the document has no such place.

    Several documents of one doc_id answer each; places of an unknown or null doc_id are left out. A
    segment's questions go to its file in eight groups of at most as many places as it has.
    """
    spark = wanted.sparkSession
    files = spark.read.parquet(path)
    index = files.select("shard", "segment", F.posexplode("doc_ids").alias("doc", "doc_id"))  # the file column is not read
    asked = wanted.select("doc_id", F.col("at").cast("bigint").alias("at")).distinct().join(index, "doc_id")
    asked = asked.groupBy("shard", "segment", F.pmod(F.xxhash64("doc", "at"), F.lit(8)).alias("salt")).agg(F.collect_list(F.struct("doc_id", "doc", "at")).alias("asked"))
    kind = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("at", T.LongType()), T.StructField("token", T.LongType())])

    def run(batches):
        for b in batches:
            for asked, file in zip(b.column("asked"), b.column("file")):
                seg = Segment(file.as_py())
                n = seg.lengths.astype(np.int64)
                starts = np.cumsum(n) - n
                rows = asked.values
                doc, at = rows.field("doc").to_numpy(), rows.field("at").to_numpy(zero_copy_only=False)
                got = [seg.access(int(starts[d] + i)) if 0 <= i < n[d] else None for d, i in zip(doc, at)]
                yield pa.RecordBatch.from_pydict({"doc_id": rows.field("doc_id"), "at": pa.array(at), "token": pa.array(got, pa.int64())})

    return asked.join(files.select("shard", "segment", "file"), ["shard", "segment"]).select("asked", "file").mapInArrow(run, schema)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write, read back, and describe every document."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer, f"{staging_dir(spark)}/wavelet-{uuid.uuid4().hex}"))
