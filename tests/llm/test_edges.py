"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tapelab.llm import exact_dedup, line_dedup, mixing, ngram_join, quality, topk

LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))


def documents(spark, rows):
    """(doc_id, text) with columns whose names the operators use themselves."""
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
            .selectExpr("*", "'s' AS source", "'x' AS kept", "1 AS n", "'y' AS row", "2 AS size", "'z' AS _text", "3 AS taken", "4 AS set_id", "5 AS n_lines"))


# ---- op1

def brute_components(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return sorted((str(i), len(s), str(low.get(find(a)))) for a, (i, s) in enumerate(sets))


def near_rows(rng_seed=3, groups=12, size=14, words=70):
    import random

    rng = random.Random(rng_seed)
    rows, n = [], 0
    common = " ".join(f"c{i}" for i in range(15))
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(6)):
                text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            rows.append((n, (common + " " if g % 2 else "") + " ".join(text)))
            n += 1
    return rows


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 70)])
def test_join_equals_brute_force(spark, k, num):
    rows = near_rows()
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "two words"), (1006, "Two  words"), (1007, LONG), (1008, LONG + " x"),
             (1009, rows[0][1]), (5, rows[40][1]), (None, rows[20][1]), (1010, "é É"), (1011, "é é")]
    got = ngram_join.group(documents(spark, rows), k=k, num=num, den=100).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, k, num, 100)


def test_join_links_only_by_chains(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[i * 2:] + [f"x{j}" for j in range(i * 2)])) for i in range(20)]
    got = ngram_join.group(documents(spark, rows), k=1, num=90).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, 1, 90, 100)


def test_join_of_nothing(spark):
    assert ngram_join.group(documents(spark, [])).count() == 0
    assert {r["component_id"] for r in ngram_join.group(documents(spark, [(1, None), (2, "")])).collect()} == {1, 2}


# ---- op2

def test_exact_dedup(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, None), (5, " \n"), (6, ""), (7, "ünïcode"), (8, "ü n ï c o d e"), (9, LONG), (10, LONG), (11, "solo"), (2, "a  b"), (None, "a  b")]
    got = exact_dedup.dedup(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    for key, members in groups.items():
        digest = hashlib.sha256(key.encode()).hexdigest()
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        mine = [r for r in got if r["text_sha256"] == digest]
        assert len(mine) == len(members) == mine[0]["group_size"]
        assert {r["keep_id"] for r in mine} == {best} and [r["doc_id"] for r in mine if r["kept"]] == [best]
    assert exact_dedup.dedup(documents(spark, [])).count() == 0


def test_exact_dedup_of_frequent_and_rare_digests(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 7}") for i in range(3000)]
    got = exact_dedup.dedup(documents(spark, rows), support=1 / 50)
    assert got.where("kept").count() == len({t for _, t in rows}) and got.count() == 3000
    assert got.where("group_size = 1000 AND keep_id = 0").count() == 1000


# ---- op4

def brute_lines(rows, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or i == max(j for j in held[key(x)] if j is not None)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    line, other = "This very line is long enough", "ünïcödé is just twenty"
    rows = [(1, f"{line}\nx"), (2, f"  {line.upper()}\t\ny\n{line}"), (3, f"{line}\n{line}\nz"), (4, None), (5, ""), (6, "\n\n"), (7, other), (8, other + "\r"), (9, other),
            (10, "short\nshort"), (11, "short"), (12, "short"), (13, "only in two documents here"), (14, "only in two documents here"),
            (15, LONG), (7, "again the id seven, " + other), (None, line), (16, "é" * 19 + "\n" + "é" * 20), (17, "é" * 19 + "\n" + "é" * 20), (18, "é" * 19 + "\n" + "é" * 20)]
    for bits in (line_dedup.MAX_BITS, 8):  # a filter that is full sends every long line, with the same result
        got = line_dedup.dedup_lines(documents(spark, rows), max_bits=bits).collect()
        assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == brute_lines(rows)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# ---- op5

def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}" if i % 5 else None) for i in range(200)] + [(300, None, "s0"), (301, "", None), (302, "a b", "empty"), (3, "w", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(7)).withColumn("n_chars", F.length("text"))
    got = mixing.sample(docs).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    goals = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert abs(sum(t for t, _ in goals.values()) - 1.5 * total) < 1e-6
    for s, (target, size) in goals.items():
        assert target <= 2 * size and abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(goals, key=lambda x: (x is None, x)))}
    free = {s: goals[s][0] / weight[s] for s in goals if goals[s][0] < 2 * goals[s][1]}
    assert max(free.values()) - min(free.values()) < 1e-6
    again = mixing.sample(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert abs(mixed.select(F.sum(mixing.words("text"))).first()[0] - sum(r["taken"] for r in got)) <= 9
    assert mixing.sample(docs.where("false")).count() == 0 and mixing.mix(docs.where("false")).count() == 0


# ---- op6

def test_top_k(spark):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (250, [float("inf")] * 8), (300, [0.5]), (301, []), (302, rows[7][1]), (303, rows[7][1]), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    import math

    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q)[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    w = topk.weights(vectors)
    for cell in (1024, 10):
        got = topk.top_k(w, w.where("vec_id % 50 = 0"), per_cell=cell)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    assert topk.digest(vectors.where("false")).count() == 0
    assert topk.digest(vectors.where("vec_id IN (50, 3)")).count() == 1


# ---- op9

def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.digest(docs, labels)
    assert got.count() == docs.count()
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg(((F.col("quality") == 1) == F.col("kept")).cast("double")).alias("a")).first()
    assert r["a"] > 0.97


def test_quality_edges(spark):
    rows = [(1, None, None, None), (2, "", "a", "en"), (3, BASE, "a", "en"), (4, "!!! ### $$$", None, "en"), (3, BASE, "a", "en"), (None, LONG, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("good", F.lit("x")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, 1), (2, None), (99, 1)], "doc_id long, quality int")
    for use in (labels, labels.where("false"), labels.where("quality = 1")):
        got = quality.digest(docs, use).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.digest(docs.where("false"), labels).count() == 0


def test_sparse_sites_stay_near_the_prior(spark):
    sites = spark.createDataFrame([("big", 900.0, 1000.0), ("bad", 100.0, 1000.0), ("one", 1.0, 1.0), ("mid", 500.0, 1000.0)], "host string, good double, all double")
    got = {r["host"]: r["rate"] for r in quality._shrink(sites, ["host"], F.lit(0.5), "rate").collect()}
    assert abs(got["big"] - 0.9) < 0.02 and abs(got["bad"] - 0.1) < 0.02 and 0.5 < got["one"] < 0.85


def test_join_of_many_texts_without_ids(spark):
    rows = [(None, f"{BASE} tail{i}") for i in range(40)] + [(None, BASE)] * 3 + [(None, f"a{i} b{i} c{i} d{i}") for i in range(40)] + [(4, BASE + " tail3 x")]
    docs = documents(spark, rows)
    got = ngram_join.group(docs, k=3, num=90).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, 3, 90, 100)


def test_join_leaves_nothing_behind(spark):
    from tapelab import session

    mark = len(session._staged)
    rows = near_rows(groups=3)
    got = ngram_join.group(documents(spark, rows), k=3, num=90)
    assert len(session._staged) == mark + 1  # the result
    assert got.count() == len(rows)


def test_mixing_spreads_a_hot_source_of_low_quality(spark):
    from tapelab.llm.mixing import sample
    from tapelab.operators import ordered

    rows = [(i if i % 3 else None, "1 2 3 " * (i % 5), "hot" if i % 4 else "src") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    keep = ordered.bucketed
    try:
        mixing.bucketed = lambda df, order, parts: seen.append(keep(df, order, parts)) or seen[-1]
        got = sample(docs, buckets=20).collect()
    finally:
        mixing.bucketed = keep
    sizes = [r["count"] for r in seen[0].groupBy("source", ordered.BUCKET).count().collect()]
    # ids that are null have one key; only rows alike in size too, which are interchangeable, share a bucket
    alike = seen[0].groupBy("source", "key", "size").count().agg(F.max("count")).first()[0]
    assert max(sizes) <= max(2 * 3000 / 20, alike + 3000 / 20)
    one = sample(docs, buckets=1).collect()
    assert sorted(map(str, one)) == sorted(map(str, got))


def test_mixing_by_a_quality_column(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s0" if i % 2 else "s1", float(i % 4 < 2)) for i in range(800)], "doc_id long, text string, source string, q double")
    got = mixing.sample(docs, share=0.2, quality_column="q").join(docs.select("doc_id", "q"), "doc_id").groupBy("q").agg(F.sum("taken").alias("n")).collect()
    n = {r["q"]: r["n"] for r in got}
    assert n[1.0] > 3 * n[0.0]
