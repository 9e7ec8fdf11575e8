"""Posteriors against plain Python, and the fitted document evidence."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tapelab.llm import quality


def concentration(sites, prior):
    """``sites``: (good, all); method of moments as the module states it."""
    n = sum(a for _, a in sites)
    n2 = sum(a * a for _, a in sites)
    spread = sum(a * (g / a - p) ** 2 for (g, a), p in zip(sites, prior))
    noise = sum(a * p * (1 - p) for (_, a), p in zip(sites, prior))
    if len(sites) < 2 or noise <= 0:
        return 1e6
    excess = spread * n / noise / len(sites) - 1
    return min(1e6, max(1.0, (n2 / n - 1) / excess - 1)) if excess > 0 else 1e6


def test_posteriors_are_those_of_plain_python(spark):
    rows = [("a", "a/x", 1.0, 1.0)] * 6 + [("a", "a/y", 0.0, 1.0)] * 5 + [("a", "a/y", 0.3, 0.1)] * 4 + [("b", "b/x", 0.0, 1.0)] * 7 + [
        ("b", None, 1.0, 1.0), (None, None, 0.5, 0.1), ("lone", "lone/x", 1.0, 1.0), ("soft", "soft/x", 0.9, 0.1)]
    base = 0.6
    paths, hosts = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for h, p, v, w in rows:
        for t in (paths[h, p], hosts[h]):
            t[0] += v * w
            t[1] += w
    hk = concentration(list(hosts.values()), [base] * len(hosts))
    prior = {h: (g + hk * base) / (a + hk) for h, (g, a) in hosts.items()}
    pk = concentration(list(paths.values()), [prior[h] for h, _ in paths])
    want = []
    for h, p, v, w in rows:
        host = (hosts[h][0] - v * w + hk * base) / (hosts[h][1] - w + hk)
        want.append((str(h), str(p), v, round(host, 6), round((paths[h, p][0] - v * w + pk * host) / (paths[h, p][1] - w + pk), 6)))
    df = spark.createDataFrame(rows, "host string, path string, value double, weight double").withColumn("good", F.lit(1)).repartition(3)
    got = [(str(r.host), str(r.path), r.value, round(r.host_rate, 6), round(r.path_rate, 6)) for r in quality.posteriors(df, base).collect()]
    assert sorted(got) == sorted(want)


def test_fit_reaches_the_least_penalised_loss():
    rng = np.random.default_rng(3)
    width = quality.SLOTS + len(quality.FEATURES) * (quality.BINS + 1)
    rows = [(np.array([i % 7, 7 + i % 3]), np.array([0.8, 0.6]), float(rng.random() < (0.9 if i % 7 < 3 else 0.2))) for i in range(600)]
    w = quality.fit(rows)
    base = math.log(np.mean([g for *_, g in rows]) / (1 - np.mean([g for *_, g in rows])))

    def loss(w):
        z = np.array([base + w[-1] + v @ w[a] for a, v, _ in rows])
        g = np.array([r[2] for r in rows])
        return np.mean(np.logaddexp(0, z) - g * z) + quality.RIDGE / 2 * float(w[:-1] @ w[:-1])

    least = loss(w)
    for k in [*range(10), width]:
        for d in (-0.3, 0.3):
            other = w.copy()
            other[k] += d
            assert loss(other) > least - 1e-6
    assert quality.fit([r for r in rows if r[2] == 1.0]) is None and quality.fit([]) is None


def test_words_decide_where_features_are_alike(spark):
    docs = [(i, " ".join(f"{'plum' if i % 2 else 'moss'}{(i * 7 + j) % 20}" for j in range(40)), f"s{i % 4}", "en") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.digest(df, labels).collect()}
    assert all((got[i]["evidence"] > 0) == bool(i % 2) for i in range(400))  # also of those held out
    again = {r["doc_id"]: r for r in quality.digest(df.repartition(7), labels).collect()}
    assert got == again


def test_a_label_does_not_speak_for_its_own_document(spark):
    docs = [(i, f"word{i % 5} " * 9, "s", "en") for i in range(60)] + [(60, "word1 " * 9, "alone", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    marks = [(i, i % 2) for i in range(60)]
    rates = []
    for own in (0, 1):
        labels = spark.createDataFrame([*marks, (60, own)], "doc_id long, quality int")
        out = quality.classify(df, labels, F.col("source"), F.col("lang")).where("doc_id = 60").first()
        rates.append((out["host_rate"], out["evidence"]))
    # only the rate of all documents, which the label is one of 61 in, moves the empty site
    assert abs(rates[0][0] - rates[1][0]) < 0.02 and rates[0][1] == rates[1][1]
