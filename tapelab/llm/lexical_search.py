"""Exact ranked lexical search by groups of equal presence masks.

Items (the queries) are worked on in blocks of bounded size, each against all documents:

1. Every text is read once; what remains of it are the block's terms in it with their numbers of
   occurrences. Document counts per term, the number of documents and the length of all texts are sums
   over that table.
2. A task takes some thousand documents at a time. A bitmap tells which terms are in which of them;
   for an item, the bitmaps of its terms, turned over, give every document the mask of the item's terms
   in it, and equal masks are one group. A mask's highest possible score is the sum over its terms
   of what the term brings at most in any of these documents. Masks are scored in descending order of
   that bound until it is below the item's k-th best score so far: no later mask can matter then.
3. A task gives its k best documents per item; they are merged in two steps, first by groups of tasks.

Nothing is broadcast but a block's terms, weights and items (BLOCK_BYTES of item text, or a single
longer item), and only those pass the driver.

Defined results. A document without terms (null, empty) is not counted and never found. An item
without terms gives no row. Rows with the same item_id are asked apart, each with ranks of its own. Rows
with the same doc_id are ranked apart; equal scores go by doc_id, null last. No documents or items: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm.batches import sliced
from tapelab.session import stage

BLOCK_BYTES = 4 << 20
CELLS = 1 << 22  # terms x documents of a bitmap at a time
FAN_IN = 64
# ASCII signs part terms, A-Z are read as a-z; every byte of a longer character is part of a term
_TERMS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


class Block:
    """Some items as numbers: ``vocabulary`` numbers the terms, ``items`` holds (terms, repeats) arrays."""

    def __init__(self, texts: list[bytes | None]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for t in texts:
            count = Counter(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in terms(t))
            self.items.append((np.array(list(count), np.int64), np.array(list(count.values()), np.int64)))


def _postings(vocabulary: dict[bytes, int]):
    def run(batches):
        get = vocabulary.get
        for b in sliced(batches):
            n, places, counts, ends = [], [], [], [0]
            for t in b.column("text").to_pylist():
                words = terms(t)
                n.append(len(words))
                held = Counter(map(get, words))
                held.pop(None, None)
                places.extend(held)
                counts.extend(held.values())
                ends.append(len(places))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return run


class _Best:
    """The k best (score, document) of an item so far, best first."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        good = np.flatnonzero(scores >= max(self.least(), 1))
        if len(good):
            new = [(int(s), ids[g]) for s, g in zip(scores[good].tolist(), good.tolist())]
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:self.k]


def _search_chunk(ids: list, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, width: int, items: list, weights: np.ndarray, best: list[_Best]):
    """Offers the documents ``ids`` to every item; (doc, term, gain) are the postings."""
    present = np.zeros((width, len(ids)), bool)
    present[term, doc] = True
    gains = np.zeros((width, len(ids)), np.int32)  # below 10**6 each
    gains[term, doc] = gain
    most = gains.max(axis=1, initial=0).astype(np.int64)
    for (mine, repeats), top in zip(items, best):
        worth = weights[mine] * repeats
        if not len(mine) or int((worth * most[mine]).sum()) < top.least():
            continue
        masks = np.packbits(present[mine], axis=0).T  # per document, the item's terms in it
        width_bytes = -(-len(mine) // 8)
        if width_bytes <= 8:
            keys = np.zeros((len(ids), 8), np.uint8)
            keys[:, :width_bytes] = masks
            distinct, first, group = np.unique(keys.view(np.uint64).ravel(), return_index=True, return_inverse=True)
        else:
            distinct, first, group = np.unique(masks, axis=0, return_index=True, return_inverse=True)
        bits = np.unpackbits(masks[first], axis=1, count=len(mine))
        bound = bits.astype(np.int64) @ (worth * most[mine])
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_mask = np.argsort(rank[group.ravel()], kind="stable")  # documents, best mask first
        ends = np.cumsum(np.bincount(group.ravel(), minlength=len(distinct))[order])
        at, step = 0, 1
        while at < len(order) and bound[order[at]] >= top.least():
            to = min(at + step, len(order))
            # the masks of this step that may still matter
            to = at + max(1, int((bound[order[at:to]] >= top.least()).sum()))
            docs = by_mask[(ends[at - 1] if at else 0):ends[to - 1]]
            top.add(worth @ gains[np.ix_(mine, docs)].astype(np.int64), [ids[d] for d in docs.tolist()])
            at, step = to, step * 4


def _searcher(shared, k: int):
    def run(batches):
        from pyspark import TaskContext

        width, items, weights = shared.value
        best = [_Best(k) for _ in items]
        room = max(64, min(8192, CELLS // max(width, 1)))
        kind = None
        for b in sliced(batches, room):
            kind = b.schema.field("doc_id").type
            m = b.column("m").to_numpy()
            lists, counts = b.column("terms"), b.column("counts").flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy()[:b.num_rows + 1])
            doc = np.repeat(np.arange(b.num_rows), sizes)
            gain = 1_000_000_000 * counts // (1000 * counts + 8 * m[doc])
            _search_chunk(b.column("doc_id").to_pylist(), doc, lists.flatten().to_numpy(), gain, width, items, weights, best)
        rows = [(i, TaskContext.get().partitionId(), s, d) for i, top in enumerate(best) for s, d in top.rows]
        if rows:
            item, part, score, doc = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(part, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, kind)],
                                             names=["item", "part", "score", "doc_id"])

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """(item ids, texts) of the items, up to ``block_bytes`` of text at a time."""
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        text = bytes(r["text"]) if r["text"] is not None else None
        if ids and size + len(text or b"") > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(text)
        size += len(text or b"") + 64
    if ids:
        yield ids, texts


def _merged(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item.

    A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); it brings w (10**9 tf div (1000 tf + 8 m)) with
    m = 100 - b + (b n N div L), once per occurrence in the item. N, L: documents with terms, all their terms.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[doc_id].dataType
    names = T.StructType([items.schema[item_id], T.StructField("item", T.IntegerType())])
    names.fields[0] = T.StructField("item_id", items.schema[item_id].dataType)
    posted = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("counts", T.ArrayType(T.LongType()))])
    found = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("score", T.LongType()),
                          T.StructField("doc_id", kind)])
    out = None
    for ids, asked in _blocks(items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text")), block_bytes):
        block = Block(asked)
        rows = stage(texts.mapInArrow(_postings(block.vocabulary), posted).where("n > 0"))
        whole = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("length")).first()
        held = np.zeros(len(block.vocabulary), np.int64)
        # one row per term of the block
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
            held[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * whole["docs"] + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
        shared = spark.sparkContext.broadcast((len(weights), block.items, weights))
        measured = rows.withColumn("m", F.expr(f"{100 - b} + ({b} * n * {whole['docs']}L) div {whole['length'] or 1}L"))
        tops = measured.select("doc_id", "m", "terms", "counts").mapInArrow(_searcher(shared, k), found)
        groups = _merged(tops.withColumn("part", F.expr(f"part div {FAN_IN}")), ["item", "part"], k)
        best = _merged(groups.select("item", "score", "doc_id"), ["item"], k)
        named = spark.createDataFrame(list(zip(ids, range(len(ids)))), names)
        part = best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], T.StructType([names.fields[0], T.StructField("rank", T.IntegerType()),
                                                                              T.StructField("doc_id", kind), T.StructField("score", T.LongType())]))
