"""Periodic runs of words, found with a dictionary of basic factors.

The basic factors are the stretches of 1, 2, 4, ... words. Every position gets a name per length, the
same name for the same words of the same document: names of length 2 L are made of the two names of
length L. Copies that start at most L words apart (so that both lie in a stretch of 2 L words)
are L-periodic there, and a factor's successors form an arithmetic progression while its period
lasts. So per length L, each position proposes the distance q to its next copy if L / 2 < q <= L, and
neighbouring positions that propose the same q are one stretch:

* Nothing is missed. A run of period q and at least 4 q words holds, for the L with L / 2 < q <= L, a
  factor and its copy q words on at every start up to its end less q + L, as q + L < 4 q. No copy is
  nearer: a factor of at least q words with a copy at a distance below q inside the run would give
  the run a smaller period.
* Nothing is found twice or too short. Such a stretch of proposals from a to b is the run from a to
  b + q + L: one more word on either side with the same period would be a proposal too. Each period
  belongs to one length.

Positions whose name is alone in its document leave, as no longer factor there can come twice; in
prose little is left after a few lengths. A batch of documents is worked on as one array; a document
stays whole, in one task.

Defined results. Null text, no words: no runs, nothing kept. Runs of a row depend on that row only, so
repeated rows and null ids give a result per row. Any further columns are not read. No rows: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm.batches import sliced

WORDS = 1 << 18  # that are named at a time, unless a document has more
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def _successors(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (sorted) whose name comes more than once, and for each the next of that name, or -1."""
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    following = np.full(len(name), -1)
    following[order[:-1][same]] = at[order[1:][same]]
    shared = np.zeros(len(name), bool)
    shared[order[:-1][same]] = True
    shared[order[1:][same]] = True
    return shared, following


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One small number per distinct pair of numbers below 2**31."""
    return np.unique(high.astype(np.int64) << 32 | low, return_inverse=True)[1]


def runs(words: np.ndarray, owner: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Start, length and period of all runs of at least max(least, times * period) words, times >= 4.

    ``words`` are numbers, equal for equal words; ``owner`` numbers the document of each, in order.
    Rows are sorted by start, then period.
    """
    found, at, length = [], np.arange(len(words)), 1
    name = _dense(owner, words) if len(words) else words
    longest = np.bincount(owner).max(initial=0)
    while len(at):
        shared, following = _successors(name, at)
        gap = np.where(following >= 0, following - at, 0)
        near = (2 * gap > length) & (gap <= length)
        start, gap = at[near], gap[near]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1] + 1) | (gap[1:] != gap[:-1])
        a = np.flatnonzero(first)
        b = np.append(a[1:], len(start)) - 1
        if len(a):
            q = gap[a]
            size = start[b] - start[a] + q + length
            held = size >= np.maximum(least, times * q)
            found.append(np.stack([start[a], size, q], axis=1)[held])
        if times * (length + 1) > longest:  # the next length is for periods above this one
            break
        at, name = at[shared], name[shared]
        place = np.searchsorted(at, at + length)
        ok = place < len(at)
        ok[ok] = at[place[ok]] == at[ok] + length
        place = place[ok]
        ok[ok] = owner[at[ok]] == owner[at[place]]
        place = np.searchsorted(at, at[ok] + length)
        name, at, length = _dense(name[ok], name[place]), at[ok], 2 * length
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbered(lists: list[list[bytes]]) -> np.ndarray:
    every = [w for words in lists for w in words]
    return np.asarray(pa.array(every, pa.large_binary()).dictionary_encode().indices, dtype=np.int64)


def _groups(texts: list, ids: list, rewrite) -> list[list[list[bytes]]]:
    """Word lists of the documents, in groups of about WORDS words."""
    groups, size = [[]], 0
    for i, t in zip(ids, texts):
        words = (t or b"").split()  # bytes split at blank and 09-0D only
        if rewrite is not None:
            words = rewrite(i, words)
        if size and size + len(words) > WORDS:
            groups.append([])
            size = 0
        groups[-1].append(words)
        size += len(words)
    return groups


def _finder(least: int, times: int, rewrite):
    def run(batches):
        for b in sliced(batches):
            cols: dict[str, list] = {c: [] for c in ("runs", "start", "length", "period", "collapsed")}
            for lists in _groups(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), rewrite):
                sizes = np.array([len(x) for x in lists])
                ends = np.cumsum(sizes)
                rows = runs(_numbered(lists), np.repeat(np.arange(len(lists)), sizes), least, times)
                cuts = np.searchsorted(rows[:, 0], np.append(0, ends))
                for words, base, lo, hi in zip(lists, ends - sizes, cuts[:-1], cuts[1:]):
                    mine = (rows[lo:hi] - (base, 0, 0)).tolist()
                    best = max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
                    if mine:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for start, size, period in mine:
                            edge[start + period] += 1
                            edge[start + size] -= 1
                        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    for c, v in zip(cols, ([dict(zip(RUN.names, r)) for r in mine], *best, b" ".join(words))):
                        cols[c].append(v)
            kinds = {"runs": pa.list_(pa.struct([pa.field(f, pa.int64(), False) for f in RUN.names])), "collapsed": pa.binary()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items())], names=["doc_id", *cols])

    return run


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, text: str = "text", doc_id: str = "doc_id",
                  rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: doc_id, runs (start, length, period of every run, by start then period), the run with the
    greatest length / period (start, length, period; ties: smallest start, then period; null without
    runs) and ``collapsed``, the words that no run holds after its first period, joined by blanks.

    ``rewrite`` maps (doc_id, words) to the words to look at.
    """
    if times < 4:
        raise ValueError("times must be at least 4")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("runs", T.ArrayType(RUN, False)),
                           *(T.StructField(c, T.LongType()) for c in RUN.names), T.StructField("collapsed", T.BinaryType())])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_finder(least, times, rewrite), schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated(doc_id, words: list[bytes]) -> list[bytes]:
    """One document in ten, by a checksum of its id, ends in a repeated passage; a null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def digest(docs: DataFrame) -> DataFrame:
    """Runs of ``docs``, one in ten ending in a repeated passage, with checksums of runs and kept words."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return periodic_runs(docs, rewrite=repeated).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.expr("length * 1000 div period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
