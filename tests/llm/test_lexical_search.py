"""Ranked lexical search against scores of every document and item."""

import math
import random
import re

from pyspark.sql import functions as F

from tapelab.llm import lexical_search as L

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    lists = [(i, words(t)) for i, t in docs]
    lists = [(i, w) for i, w in lists if w]
    n_docs, length = len(lists), sum(len(w) for _, w in lists)
    df = {}
    for _, w in lists:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked, rows = words(text), []
        for i, w in lists:
            m = 25 + 75 * len(w) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked if t in w)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k])]
    return sorted(map(str, out))


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "'x' AS score", "1 AS n", "2 AS m", "3 AS item", "4 AS terms", "5 AS part")
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("r"))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ß", "x9"]
    docs = [(i, rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=rng.randrange(30)))) for i in range(300)]
    docs += [(i + 1000, docs[i % 7][1]) for i in range(40)] + [(400, None), (401, ""), (402, " .,!"), (5, "w1 w2"), (None, "w1 w59"), (403, "w3 " * 50_000), (404, "W1,w1;ÜNÏ ünï")]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for j in range(12)]
    items += [(50, None), (51, ""), (52, "?!"), (3, "w1 w1 w1 w40"), (None, "w2 x9"), (53, " ".join(vocabulary)), (54, "unknown words only"),
              (55, " ".join(vocabulary + [f"odd{i}" for i in range(40)]))]
    d, q = tables(spark, docs, items)
    want = brute(docs, items)
    assert rows_of(L.search(d, q)) == want
    assert rows_of(L.search(d, q, block_bytes=100)) == want
    monkeypatch.setattr(L, "CELLS", 1)  # small chunks
    assert rows_of(L.search(d, q, k=3)) == brute(docs, items, 3)


def test_equal_scores_and_nothing(spark):
    d, q = tables(spark, [(i, "same words here") for i in range(50, 0, -1)] + [(99, "other")], [(1, "same"), (2, "Other here")])
    assert rows_of(L.search(d, q)) == brute([(i, "same words here") for i in range(1, 51)] + [(99, "other")], [(1, "same"), (2, "Other here")])
    assert L.search(d.where("false"), q).count() == 0 and L.search(d, q.where("false")).count() == 0
    assert L.search(d, q.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
