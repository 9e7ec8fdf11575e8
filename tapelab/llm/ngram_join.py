"""N-gram Jaccard join by prefixes under several global token orders.

A document is the set of its k-word shingles. If two sets of sizes a and b reach the threshold, then
under *any* order of all shingles their prefixes of size n - ceil(t * n) + 1 share a shingle.
Three orders are used: rare first (by a count sketch over all documents, ties by hash), rare
first with other ties, and by hash alone. Postings are made of the first; a pair found there must
also meet in the prefixes of the second and third before its sets are compared.

Equal sets are one class and are compared once: a task gives prefixes for the first row of a set, and
of several tasks' first rows one is the class. Among classes, links are sought in two steps, so
that a large group of near copies never gives all its pairs:

1. Star: per prefix shingle, every class is compared with the one that has the shingle earliest
   in its prefix, the one with fewest odd shingles. The links give components.
2. Rest: where a shingle's classes still are in different components, all pairs between different
   components are candidates. A pair inside one component could not change the result.

Filters before the comparison, all without loss: sizes; the sum of both positions of a shared
shingle, as shingles before the first shared one must not exceed the allowed difference; and
histograms of BUCKETS hash ranges, as their difference is at most that of the sets.

Defined results. Null text or a text without words: an empty set, linked with nothing, n_shingles
0, component of its own. Fewer than k words: one shingle. Rows with equal doc_id, null ones too, are
taken as separate texts under one id. Sets are compared by 64-bit shingle hashes, classes by 128 bits.
What is written on the way is deleted at the end; texts are not written a second time.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm.batches import sliced
from tapelab.llm.components import components
from tapelab.llm.shingles import mix, sets
from tapelab.session import small, stage, staging

MAX_CELLS = 1 << 25  # of the count sketch: 32 MB once broadcast
CHUNK = 1 << 17
FAN_IN = 64
BUCKETS = 128
SEEN = 1 << 20  # sets that a task remembers
_SIZE = 1 << 32


def _counter(k: int, cells: int):
    def run(batches):
        from pyspark import TaskContext

        counts = np.zeros(cells, np.uint32)
        for b in sliced(batches):
            held, size = [], 0
            for s in sets(b.column("text").to_pylist(), k):
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    np.add.at(counts, (np.concatenate(held) & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
                    held, size = [], 0
            if size:
                np.add.at(counts, (np.concatenate(held) & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
        slot = TaskContext.get().partitionId()
        for c in range(0, cells, CHUNK):
            part = counts[c:c + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c // CHUNK], pa.int32()), "slot": pa.array([slot], pa.int32()),
                                                  "counts": pa.array([_pack(part)])})

    return run


def _pack(counts: np.ndarray) -> bytes:
    kind = np.dtype("<u1" if counts.max(initial=0) < 256 else "<u8")
    return bytes([kind.itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [key[0]], "slot": [key[1]], "counts": [_pack(sum(_unpack(b) for b in rows["counts"]))]})


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """Per sketch cell, how often its shingles occur, in eighths of a doubling up to 127.

    Counts of all documents are added in a tree of FAN_IN tasks; one byte per cell comes back.
    """
    n = docs.count()
    cells = max(CHUNK, min(MAX_CELLS, 1 << int(64 * n).bit_length()))
    schema = "chunk int, slot int, counts binary"
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counter(k, cells), schema)
    slots = rows.rdd.getNumPartitions()
    while slots > 1:
        slots = -(-slots // FAN_IN)
        rows = rows.withColumn("slot", F.expr(f"slot div {FAN_IN}").cast("int")).groupBy("chunk", "slot").applyInPandas(_add, schema)
    levels = np.zeros(cells, np.uint8)
    for r in rows.select("chunk", F.col("counts")).toLocalIterator():
        part = np.minimum(8 * np.log2(np.maximum(_unpack(r["counts"]), 1)), 127)
        levels[r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(part)] = part
    return levels


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signer(shared, k: int, num: int, den: int):
    def run(batches):
        from pyspark import TaskContext

        levels = shared.value
        low = np.uint64(len(levels) - 1)
        seen: set[bytes] = set()
        row = TaskContext.get().partitionId() << 40
        none = np.zeros(0, np.int64)
        for b in sliced(batches):
            n, ids, lead, first, second, third, hist = [], [], [], [], [], [], []
            for s in sets(b.column("text").to_pylist(), k):
                n.append(len(s))
                ids.append(_set_id(s) if len(s) else None)
                lead.append(len(s) > 0 and ids[-1] not in seen)
                if not lead[-1]:
                    for x in (first, second, third, hist):
                        x.append(none)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(ids[-1])
                p = len(s) - -(-num * len(s) // den) + 1
                level = levels[(s & low).astype(np.int64)].astype(np.uint64) << np.uint64(57)
                a = np.sort(mix(s, 1) >> np.uint64(7) | level)[:p]
                other = np.argsort(mix(s, 2) >> np.uint64(7) | level)[:p]
                plain = np.argsort(mix(s, 3))[:p]
                first.append(a.view(np.int64))
                second.append(s[other].astype(np.uint32).view(np.int32))
                third.append(s[plain].astype(np.uint32).view(np.int32))
                hist.append(np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 127).astype(np.int8))
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate(x or [none]).astype(kind))
                     for x, kind in ((first, np.int64), (second, np.int32), (third, np.int32), (hist, np.int8))]
            rows = pa.array(np.arange(row, row + len(n)))
            row += len(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), rows, pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                                              pa.array(lead, pa.bool_()), *lists],
                                             names=["doc_id", "mark", "row", "n", "set_id", "lead", "first", "second", "third", "hist"])

    return run


def _set_maker(k: int):
    def run(batches):
        for b in sliced(batches):
            out = [(c, s.tobytes()) for c, i, s in zip(b.column("cid").to_pylist(), b.column("set_id").to_pylist(), sets(b.column("text").to_pylist(), k))
                   if len(s) and _set_id(s) == i]
            if out:
                c, s = zip(*out)
                yield pa.RecordBatch.from_pydict({"cid": pa.array(c, pa.int64()), "s": pa.array(s, pa.binary())})

    return run


def _comparer(num: int, den: int):
    def run(batches):
        for b in sliced(batches):
            keep = []
            for x, y in zip(b.column("sx").to_pylist(), b.column("sy").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fits(nx: Column, ny: Column, px: Column, py: Column, num: int, den: int) -> Column:
    """Whether sizes and positions of a shared shingle allow the threshold."""
    need = F.ceil((nx + ny) * num / F.lit(num + den))
    return (need <= F.least(nx, ny)) & (px + py <= nx + ny - 2 * need)


def _near(nx: Column, ny: Column, hx: Column, hy: Column, num: int, den: int) -> Column:
    """Whether two histograms differ by no more than the sets may."""
    need = F.ceil((nx + ny) * num / F.lit(num + den))
    apart = F.aggregate(F.zip_with(hx, hy, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda s, d: s + d)
    return apart <= nx + ny - 2 * need


class _Join:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        shared = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, k))
        # ids may be null or repeated, so a text is found again by its id and a hash of it
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
        schema = T.StructType([docs.schema["doc_id"], T.StructField("mark", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()),
                               T.StructField("set_id", T.BinaryType()), T.StructField("lead", T.BooleanType()),
                               T.StructField("first", T.ArrayType(T.LongType())), T.StructField("second", T.ArrayType(T.IntegerType())),
                               T.StructField("third", T.ArrayType(T.IntegerType())), T.StructField("hist", T.ArrayType(T.ByteType()))])
        self.rows = stage(self.docs.mapInArrow(_signer(shared, k, num, den), schema))
        classes = self.rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min(F.when(F.col("lead"), F.col("row"))).alias("cid"))
        self.classes = stage(classes)
        leads = self.rows.where("lead")
        copies = stage(leads.select("row", "set_id").join(self.classes.select("set_id", "cid"), "set_id").where("row != cid").select(F.col("row").alias("cid")))
        self.nodes = leads.withColumnRenamed("row", "cid").join(small(copies), "cid", "left_anti")

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that also meet under the other orders and whose sets reach the threshold."""
        pairs = stage(pairs.distinct())
        leads = self.rows.where("lead")
        x, y = (leads.select(F.col("row").alias(c), *[F.col(v).alias(f"{c}_{v}") for v in ("n", "second", "third", "hist")]) for c in "xy")
        both = F.arrays_overlap("x_second", "y_second") & F.arrays_overlap("x_third", "y_third")
        near = _near(F.col("x_n"), F.col("y_n"), F.col("x_hist"), F.col("y_hist"), self.num, self.den)
        met = stage(pairs.join(x, "x").join(y, "y").where(near & both).select("x", "y"))
        left = met.select(F.col("x").alias("cid")).union(met.select("y")).distinct()
        chosen = stage(left.join(leads.select(F.col("row").alias("cid"), "set_id", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "cid"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
        texts = self.docs.join(small(chosen), same).select("cid", "set_id", "text")
        made = stage(texts.mapInArrow(_set_maker(self.k), "cid long, s binary").dropDuplicates(["cid"]))
        sx, sy = (made.select(F.col("cid").alias(c), F.col("s").alias(f"s{c}")) for c in "xy")
        return stage(met.join(sx, "x").join(sy, "y").select("x", "y", "sx", "sy").mapInArrow(_comparer(self.num, self.den), "x long, y long"))

    def _fits(self, x: str, y: str) -> Column:
        """Whether the sizes and positions packed in two columns allow the threshold."""
        n, pos = (lambda c: F.col(c).bitwiseAND(F.lit(_SIZE - 1))), (lambda c: F.shiftright(c, 32))
        return _fits(n(x), n(y), pos(x), pos(y), self.num, self.den)

    def components(self) -> DataFrame:
        """(node, comp) of the classes that have a link, by cid."""
        # position and size in one number: the least is earliest, then smallest
        postings = self.nodes.select("cid", "n", F.posexplode("first").alias("pos", "token")).select(
            "token", "cid", (F.col("pos") * F.lit(_SIZE) + F.col("n")).alias("at"))
        heads = (postings.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.min("at").alias("head_at"), F.min_by("cid", "at").alias("head"))
                 .where("docs > 1").select("token", "head_at", "head"))
        shared = stage(postings.join(heads, "token"))
        star = shared.where(F.col("cid") != F.col("head")).where(self._fits("at", "head_at"))
        links = self._links(star.select(F.least("cid", "head").alias("x"), F.greatest("cid", "head").alias("y")))
        comps = components(links)
        known = stage(shared.join(comps.withColumnRenamed("node", "cid"), "cid", "left")
                      .select("token", "at", "cid", F.coalesce("comp", "cid").alias("comp"), "head"))
        open_ = known.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("token")
        hist = self.rows.where("lead").select(F.col("row").alias("cid"), "n", "hist")
        rest = stage(known.join(open_, "token", "left_semi").join(hist, "cid"))
        a, b = rest.alias("a"), rest.alias("b")
        cross = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.cid") < F.col("b.cid")) & (F.col("a.comp") != F.col("b.comp"))
                       & (F.col("a.cid") != F.col("a.head")) & (F.col("b.cid") != F.col("b.head")) & self._fits("a.at", "b.at")
                       & _near(F.col("a.n"), F.col("b.n"), F.col("a.hist"), F.col("b.hist"), self.num, self.den))
        more = self._links(cross.select(F.col("a.cid").alias("x"), F.col("b.cid").alias("y")))
        return components(links.unionByName(more))


def group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the component) of every row; links: Jaccard >= num / den."""
    with staging(docs.sparkSession) as keep:
        job = _Join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k, num, den)
        comps = job.components().withColumnRenamed("node", "cid")
        named = stage(job.classes.join(comps, "cid", "left").select("set_id", "doc_id", F.coalesce("comp", "cid").alias("comp")))
        least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        ids = named.join(least, "comp").select("set_id", "component_id")
        return keep(job.rows.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(ids, "set_id", "left").select(
            "doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
