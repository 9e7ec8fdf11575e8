"""Periodic runs against a definition read word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tapelab.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                x = w[i:i + size]
                if not any(x[p:] == x[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best, gone = (None,) * 4, set()
    for s, size, q in found:
        gone |= set(range(s + q, s + size))
        if best[0] is None or size * best[2] > best[1] * q:
            best = (s, size, q, 1000 * size // q)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            w = []
            for _ in range(rng.randrange(4)):
                w += [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 10))] * rng.randrange(1, 8)
            docs.append(w[:len(w) - rng.randrange(len(w) + 1) // 6])
        want, base = [], 0
        for w in docs:
            want += [(s + base, size, q) for s, size, q in brute(w)]
            base += len(w)
        got = P.runs(np.array([x for w in docs for x in w], np.int64), np.repeat(np.arange(len(docs)), list(map(len, docs))))
        assert list(map(tuple, got.tolist())) == want


def test_digest_of_odd_texts(spark):
    ten = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(1, None), (2, ""), (3, " \t\n"), (5, "a " * 6), (6, "a " * 5), (7, "a b " * 4), (8, "A a " * 4 + "b"), (9, "é  ü\n" * 5), (5, "a " * 6), (None, "x y z " * 9),
            (11, "a a a a a a b a a a a a a b " * 5), (12, "x " * 30_000), (13, " ".join(f"w{i % 700}" for i in range(9_000)))]
    rows += [(i, " ".join(f"v{(i * k) % 97}" for k in range(i % 60))) for i in ten]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS start", "'x' AS runs", "2 AS period", "'c' AS collapsed")
    got = P.digest(docs).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(expected(*r)) for r in rows)
    assert P.digest(docs.where("false")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r) for r in P.digest(docs).collect()}
    assert got == {expected(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_and_words_come_back(spark):
    docs = spark.createDataFrame([(1, "p q  r " + "a b " * 4 + "z")], "doc_id long, text string")
    r = P.periodic_runs(docs).first()
    assert [tuple(x) for x in r["runs"]] == [(3, 8, 2)] and r["collapsed"] == "p q r a b z"
    assert P.periodic_runs(docs.select("doc_id", F.upper("text").alias("text")), least=9).first()["runs"] == []
