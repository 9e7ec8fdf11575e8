"""Exact top-k search by term-at-a-time accumulation.

Vectors become sparse integer rows: a term is a dimension, its weight floor(scale * x). Queries
and candidates are dealt into a grid of cells of bounded size (groups of queries x groups of
candidates). In a cell each term's postings (candidates with a weight) are scattered, times the
queries' weights, into a dense array of scores, one block of queries at a time; a partition
selection leaves k candidates per query, and a last selection merges the cells.

Defined results. A null vector, or one with null or non-finite components, takes no part. Vectors
of different lengths: missing terms weigh 0. An empty vector scores 0 with all. A query leaves out
every row with its own vec_id; null vec_ids take no part. Repeated candidate rows are ranked
apart; a repeated query id is asked once, with its largest vector. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 1024
QUERIES = 4096
SCORES = 1 << 21  # entries of the score array at a time


def weights(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and w, an array of integer weights, of the rows that take part."""
    x = F.col(embedding)
    good = x.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(good).select(F.col(vec_id).cast("long").alias("vec_id"),
                                      F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("w"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _cell(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(queries) or not len(candidates):
            return empty
        candidates = candidates.sort_values("vec_id", kind="stable")
        width = max(queries["w"].map(len).max(), candidates["w"].map(len).max())
        q, c = _matrix(queries["w"], width), _matrix(candidates["w"], width)
        q_ids, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        bound = float((np.abs(q).max(axis=0, initial=0).astype(float) * np.abs(c).max(axis=0, initial=0)).sum())
        kind = np.int32 if bound < 2**31 else np.int64
        postings = [np.flatnonzero(c[:, t]) for t in range(width)]
        values = [c[p, t].astype(kind) for t, p in enumerate(postings)]
        out, step = [], max(1, SCORES // len(ids))
        tail = np.arange(len(ids), 0, -1)  # earlier ids win ties
        for at in range(0, len(q_ids), step):
            part = q[at:at + step]
            scores = np.zeros((len(part), len(ids)), kind)
            for t in range(width):
                asked = np.flatnonzero(part[:, t])
                if not len(asked) or not len(postings[t]):
                    continue
                added = np.multiply.outer(part[asked, t].astype(kind), values[t])
                if added.shape == scores.shape:
                    scores += added
                else:
                    scores[np.ix_(asked, postings[t])] += added
            ranks = scores.astype(np.int64) * (len(ids) + 1) + tail if bound * (len(ids) + 1) < 2**62 else None
            for i, query in enumerate(q_ids[at:at + step]):
                others = np.flatnonzero(ids != query)
                if ranks is None:
                    best = others[np.lexsort((-tail[others], -scores[i, others]))[:k]]
                else:
                    r = ranks[i, others]
                    best = others[np.argpartition(-r, k)[:k]] if len(others) > k else others
                out.append((np.full(len(best), query), ids[best], scores[i, best].astype(np.int64)))
        a, b, s = map(np.concatenate, zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, per_cell: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``queries`` its k best rows of ``rows`` (both vec_id, w)."""
    groups = max(1, -(-rows.count() // per_cell))
    blocks = max(1, -(-queries.count() // QUERIES))
    queries = queries.groupBy("vec_id").agg(F.max("w").alias("w"))
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    left = queries.select("vec_id", "w", spread(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell"))
    right = rows.select("vec_id", "w", spread(groups, 2).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInPandas(
        _cell(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k))


def digest(vectors: DataFrame) -> DataFrame:
    rows = weights(vectors)
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))
