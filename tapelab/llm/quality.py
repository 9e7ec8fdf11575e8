"""Quality classifier with hierarchical empirical Bayes over sites, in grouped aggregations.

Document evidence: a logistic regression over hashed words (``SLOTS`` of them, 1 + ln of the count, scaled to
length 1) and five features of the text cut into bins. It is fitted on at most ``FIT_ROWS`` labelled
documents, those with the smallest hash of their id; every document is scored. Two models are fitted, each
on one half of the ids, and a document is scored by the model of the other half, so that no label
speaks for its own document. The evidence is the model's log-odds less those of its training labels.
Site evidence: good and all documents per host and per path below a host, where a labelled document
counts 1 and any other ``SOFT`` of its own probability. Hosts are beta-binomial around the global
rate, with a concentration from the spread of host rates (method of moments); a host's posterior
mean is the prior of its paths, in the same way. A sparse site so stays near what is above it.
What a document itself added is taken out of its host and path before they are used for it.
The final log-odds are document evidence plus those of the path's posterior mean.

Texts are read twice (labelled sample, scoring) and never shuffled; only ids, sites and sums are. The driver
sees the sample's features (at most ``FIT_ROWS`` x (``SLOTS`` + 105) numbers); both models are in the tasks' closure.

Defined results. Null text counts as empty. A null host or path is a site of that name. Labels
that are null are no labels; repeated labels of a document count once, good if any is. A half without
labels of both kinds gives evidence 0, no labels at all a rate of a half. Rows of one id share its label; the
sample takes one of them. Every row of ``docs`` gives one row.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.llm.batches import sliced
from tapelab.llm.language_id import held_out
from tapelab.session import small, stage

SOFT = 0.1
BINS = 20
SLOTS = 4096
FIT_ROWS = 8000
ROUNDS = 200
RIDGE = 1e-4
LIMIT = 12.0  # of the document's log-odds, and the widest prior odds
FEATURES = ("odd_signs", "capitals", "distinct_words", "word_length", "lines")


def features(text) -> list[Column]:
    """Bin numbers 0 to BINS of the features, in the order of FEATURES."""
    t = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    k = F.greatest(F.size(words), F.lit(1)).cast("double")
    share = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n
    scaled = (
        share(r"[^A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D.,]+") * BINS * 4,
        share("[A-Z]+") * BINS,
        F.size(F.array_distinct(words)) / k * BINS,
        n / k,
        (F.length(t) - F.length(F.regexp_replace(t, "\n", ""))) / k * BINS,
    )
    return [F.least(F.floor(x), F.lit(BINS)).cast("int") for x in scaled]


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def vector(text: str | None, bins: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a document: its words hashed to SLOTS, then one slot per feature and bin."""
    counts: Counter[int] = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        counts[zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS] += n
    slots = np.fromiter(counts.keys(), np.int32, len(counts))
    values = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    values /= max(1e-9, float(np.sqrt((values * values).sum())))
    own = SLOTS + np.arange(len(bins), dtype=np.int32) * (BINS + 1) + np.array(bins, np.int32)
    return np.concatenate((slots, own)), np.concatenate((values, np.full(len(bins), 0.5)))


def fit(rows: list) -> np.ndarray | None:
    """Weights of all slots and, last, 0; None unless both kinds occur. ``rows``: (slots, values, good).

    Penalised logistic regression by accelerated gradient steps; the intercept is left out of the weights.
    """
    good = np.array([r[2] for r in rows], np.float64)
    if not len(good) or good.min() == good.max():
        return None
    width = SLOTS + len(FEATURES) * (BINS + 1)
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    base = np.log(good.mean() / (1 - good.mean()))
    w, ahead, shift, shift_ahead, speed = np.zeros(width), np.zeros(width), 0.0, 0.0, 1.0
    step = 4.0 / (2.0 + 0.25 * len(FEATURES))  # the squared length of a row, with its intercept, is at most this divisor
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(base + shift_ahead + np.bincount(row, value * ahead[at], len(rows)))))
        miss = (p - good) / len(rows)
        new = ahead - step * (np.bincount(at, value * miss[row], width) + RIDGE * ahead)
        new_shift = shift_ahead - step * miss.sum()
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, shift_ahead = new + (speed - 1) / faster * (new - w), new_shift + (speed - 1) / faster * (new_shift - shift)
        w, shift, speed = new, new_shift, faster
    return np.append(w, shift)


def fold(doc_id: str = "doc_id") -> Column:
    """The half, 0 or 1, of an id; null ids are in half 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("half")), F.lit(2)), F.lit(0)).cast("int")


def models(docs: DataFrame, marks: DataFrame) -> dict[int, np.ndarray | None]:
    """Per half the model fitted on the labelled sample of the other half. ``marks``: _id, good."""
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most FIT_ROWS rows
    rows = rows.select(F.col("_id").cast("string").alias("id"), fold("_id").alias("half"), F.col("good"), "text", F.array(*features("text")).alias("bins"))

    def run(batches):
        for b in sliced(batches):
            found = [vector(t, x) for t, x in zip(b.column("text").to_pylist(), b.column("bins").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("half"), b.column("good"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
                names=["id", "half", "good", "slots", "values"])

    vectors = rows.mapInArrow(run, "id string, half int, good double, slots array<int>, values array<double>")
    one = vectors.groupBy("id", "half", "good").agg(F.min(F.struct("slots", "values")).alias("v"))
    sample = sorted(one.collect(), key=lambda r: r["id"])  # at most FIT_ROWS
    halves = {h: [(np.array(r["v"]["slots"]), np.array(r["v"]["values"]), r["good"]) for r in sample if r["half"] == h] for h in (0, 1)}
    return {0: fit(halves[1]), 1: fit(halves[0])}


def evidence(docs: DataFrame, model: dict[int, np.ndarray | None]) -> DataFrame:
    """doc_id, host, path and evidence of rows with doc_id, host, path and text; the texts stay behind."""
    rows = docs.select("doc_id", "host", "path", F.coalesce("text", F.lit("")).alias("text"), fold().alias("half")).withColumn("bins", F.array(*features("text")))

    def run(batches):
        for b in sliced(batches):
            out = []
            for text, bins, half in zip(b.column("text").to_pylist(), b.column("bins").to_pylist(), b.column("half").to_pylist()):
                w = model[half]
                if w is None:
                    out.append(0.0)
                    continue
                at, value = vector(text, bins)
                out.append(float(np.clip(value @ w[at] + w[-1], -LIMIT, LIMIT)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(out, pa.float64())], names=["doc_id", "host", "path", "evidence"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, path string, evidence double")


def _concentration(sites: DataFrame, prior: Column) -> float:
    """How many documents the prior of a site is worth, one number for all sites."""
    rate = F.col("good") / F.col("all")
    m = sites.where("all > 0").agg(
        F.sum("all").alias("n"), F.sum(F.col("all") * F.col("all")).alias("n2"), F.count(F.lit(1)).alias("sites"),
        F.sum(F.col("all") * F.pow(rate - prior, F.lit(2.0))).alias("spread"), F.sum(F.col("all") * prior * (1 - prior)).alias("noise")).first()
    kappa = 1e6  # as if all sites were alike
    if m["sites"] and m["sites"] > 1 and m["noise"] > 0:
        # E[spread] = noise * (1 + (n_eff - 1) / (kappa + 1)) / n_eff per document, n_eff the mean size
        size = m["n2"] / m["n"]
        excess = m["spread"] * m["n"] / m["noise"] / m["sites"] - 1
        kappa = min(1e6, max(1.0, (size - 1) / excess - 1)) if excess > 0 else kappa
    return kappa


def _posterior(good: Column, count: Column, prior: Column, kappa: float) -> Column:
    return (good + kappa * prior) / (count + kappa)


def _shrink(sites: DataFrame, keys: list[str], prior: Column, name: str) -> DataFrame:
    """Posterior mean of each site around ``prior``, with one concentration for all sites."""
    return sites.select(*keys, _posterior(F.col("good"), F.col("all"), prior, _concentration(sites, prior)).alias(name))


def posteriors(rows: DataFrame, base: float) -> DataFrame:
    """``rows`` (host, path, value, weight) with host_rate and path_rate, each without the row's own value."""
    paths = stage(rows.groupBy("host", "path").agg(F.sum(F.col("weight") * F.col("value")).alias("good"), F.sum("weight").alias("all")))
    hosts = stage(paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("all").alias("host_all")))
    host_kappa = _concentration(hosts.select(F.col("host_good").alias("good"), F.col("host_all").alias("all")), F.lit(base))
    below = paths.join(small(hosts.withColumnRenamed("host", "_host")), F.col("host").eqNullSafe(F.col("_host")))
    below = below.withColumn("_prior", _posterior(F.col("host_good"), F.col("host_all"), F.lit(base), host_kappa))
    path_kappa = _concentration(below, F.col("_prior"))
    sites = stage(below.select("_host", F.col("path").alias("_path"), F.col("good").alias("path_good"), F.col("all").alias("path_all"), "host_good", "host_all"))
    out = rows.join(small(sites), F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    own, mass = F.col("weight") * F.col("value"), F.col("weight")
    without = lambda total, part: F.greatest(F.col(total) - part, F.lit(0.0))
    out = out.withColumn("host_rate", _posterior(without("host_good", own), without("host_all", mass), F.lit(base), host_kappa))
    out = out.withColumn("path_rate", _posterior(without("path_good", own), without("path_all", mass), F.col("host_rate"), path_kappa))
    return out.select(*rows.columns, "host_rate", "path_rate")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, learn: Column | None = None,
             threshold: float = 0.25) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score and kept of every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality (1 good, 0 bad). ``learn``, a condition on doc_id, says which may be learnt from.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("good"))
    marks = (marks if learn is None else marks.where(learn)).withColumnRenamed("doc_id", "_id")
    named = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    rows = evidence(named, models(named, marks)).join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    rows = stage(rows)
    base = rows.agg(F.avg("good")).first()[0]
    base = 0.5 if base is None else min(1 - 1e-6, max(1e-6, base))
    own = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.lit(base)))))
    valued = rows.withColumns({"value": F.coalesce("good", own), "weight": F.when(F.col("good").isNull(), F.lit(SOFT)).otherwise(F.lit(1.0))})
    placed = posteriors(valued, base)
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate")))))
    return placed.select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"),
                         F.round("path_rate", 6).alias("path_rate"), F.round(score, 6).alias("score")).withColumn("kept", F.col("score") >= threshold)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Hosts are sources, paths are languages within a source; learnt from the rows that are not held out."""
    out = classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"), ~held_out())
    return out.withColumn("held_out", held_out())
