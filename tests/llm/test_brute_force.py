"""Operators that SQL cannot express, against plain Python on small inputs."""

import functools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm import language_id, packing, tokens, wavelet

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "foo  bar", " lead", "trail ", "a\tb\x1cc", "x\n\ny", "x \ny", "x\n y", "<|endoftext|> <|startoftext|>",
       "it's don't 'tis 12,34 x_y (a) [b] e.g.", "ÀÉ straße ΣΟΦΟΣ İx é  nb", "CAFÉ, café. 日本語 テキスト", "a" * 5000, "w. " * 4000 + "w",
       "one,two;three::four ... !?", "naïve-é!", "²½ x² 10²", "  sep", "A̸. b"]


@functools.lru_cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(spark, name):
    path = tokens.tokenizer_path(name)
    enc = tokens.Encoder(path)
    texts = ODD[1:] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts + texts:  # the second time from the caches
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == whole(path, t), repr(t[:80])


def odd_docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "twice", "x"), (3, "twice", "x"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)


def test_packing(spark):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    docs = odd_docs(spark)
    rows = packing.pack(docs, path, window=256).collect()
    got = {}
    for r in rows:
        assert r["length"] > 0 and r["offset"] + r["length"] <= 256 and len(r["ids"]) == 4 * r["length"]
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        got.setdefault(r["sequence_id"], []).append(r)
    for s, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or s == max(got)
    assert sorted(got) == list(range(len(got)))
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(whole(path, r["text"] or "") + [2])) for r in docs.collect())
    have = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        have.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append(r)
    flat = []
    for k, pieces in have.items():
        doc = []
        for r in pieces:
            assert r["start"] == len(doc)
            doc += np.frombuffer(r["ids"], "<u4").tolist()
            if len(doc) == r["doc_tokens"]:
                flat.append((k, tuple(doc)))
                doc = []
        assert not doc
    assert sorted(flat) == want
    assert packing.pack(docs.where("false"), path).count() == 0


def test_wavelet_round_trip(spark, tmp_path):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    docs = odd_docs(spark).where("doc_id is null or doc_id != 3 or text != 'twice'")
    out = wavelet.write(docs, path, str(tmp_path / "files"), shards=3, segment=500)
    got = {r["doc_id"]: r for r in wavelet.read(spark, out).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array(whole(path, r["text"] or "") + [2], "<u4")
        g = got.pop(r["doc_id"])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
    empty = wavelet.write(docs.where("false"), path, str(tmp_path / "none"))
    assert wavelet.read(spark, empty).count() == 0


def test_wavelet_lookups_over_all_shards(spark, tmp_path):
    """Counts, places and ids of a folder of several shards and segments, documents with equal ids among them."""
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    rows = [(k, "the cat and the dog " * (k % 7) + f"number {k}") for k in range(60)] + [(7, "the the"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("mine"))
    out = wavelet.write(docs, path, str(tmp_path / "files"), shards=3, segment=150)
    assert spark.read.parquet(out).count() > 6
    want = [(k, whole(path, t or "") + [2]) for k, t in rows]
    common = [t for t, _ in Counter(t for _, ids in want for t in ids).most_common(5)]
    asked = [*common, 2, 49_000, 1 << 20, common[0]]
    flat = Counter(t for _, ids in want for t in ids)
    assert {r.token: r.n for r in wavelet.count(spark, out, asked).collect()} == {t: flat[t] for t in asked}
    got = sorted((r.token, r.doc_id, r.at) for r in wavelet.positions(spark, out, asked).collect())
    assert got == sorted((t, k, i) for k, ids in want for i, t in enumerate(ids) if t in set(asked))
    places = [(k, i) for k in (0, 7, 33, 59, 99) for i in (0, 1, 5, 40, -1)] * 2
    there = wavelet.access(spark.createDataFrame(places, "doc_id long, at long"), out).collect()
    assert sorted((r.doc_id, r.at, -1 if r.token is None else r.token) for r in there) == sorted(
        (k, i, ids[i] if 0 <= i < len(ids) else -1) for k, i in set(places) for d, ids in want if d == k)
    # all starts follow each other also among documents of one id
    starts = sorted((r.start, r.n_tokens) for r in wavelet.read(spark, out).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    none = wavelet.write(docs.where("false"), path, str(tmp_path / "none"))
    assert wavelet.positions(spark, none, [2]).count() == 0 and wavelet.count(spark, none, [2]).first().n == 0


def test_wavelet_queries():
    rng = random.Random(1)
    for n in (1, 511, 512, 513, 5000):
        ids = np.array([rng.choice([0, 1, 2, 500, 50256, rng.randrange(1 << 16)]) for _ in range(n)], "<u2")
        seg = wavelet.Segment(wavelet.build(ids, np.array([n]), 16))
        assert (seg.ids() == ids).all()
        for _ in range(40):
            at = rng.randrange(n)
            token = int(ids[at])
            assert seg.access(at) == token
            places = np.flatnonzero(ids == token)
            assert seg.rank(token) == len(places) and seg.rank(token, at) == (places < at).sum()
            k = rng.randrange(len(places))
            assert (seg.places(token) == places).all()
            assert seg.select(token, k) == places[k] and seg.select(token, len(places)) == -1
        assert len(seg.places(1 << 16)) == 0 and seg.rank(1 << 16) == 0 and seg.rank(777) == (ids == 777).sum()


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    r = got.where("held_out and lang_pred != 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert r["a"] > 0.97
    bad = got.where("score < 0 or score > 1 or score is null").count()
    assert bad == 0


def test_language_edge_cases(spark):
    rows = [(1, "hello world the cat", "en"), (5, "hallo welt die katze und", "de"), (6, None, "en"), (7, "", None), (8, "12 !?", "de"),
            (9, "die welt", None), (None, "the cat", None), (1, "hello world the cat", "en"), (10, "x " * 1_200_000, None), (11, "the cat and world", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (6, 7, 8))
    assert by[9]["lang_pred"] == "de" and by[None]["lang_pred"] == "en"
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast(T.StringType())))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language_id.identify(docs.where("false")).count() == 0


def test_naive_bayes_against_plain_counts(spark):
    """The posterior equals one made from n-grams in Python dictionaries."""
    import math
    from collections import Counter

    rows = [(1, "the cat sat", "en"), (5, "die katze", "de"), (9, "cat die", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, bits=16)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}

    def grams(t):
        t = f"\x01 {' '.join(t.split())} "
        return Counter(t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if "\x01" not in t[i:i + n])

    counts = {lang: grams(t) for _, t, lang in rows if lang}
    used = len(set().union(*counts.values())) + 1
    logs = {g: math.log(0.5) + sum(k * math.log((c[x] + 0.1) / (c.total() + 0.1 * used)) for x, k in grams("cat die").items()) for g, c in counts.items()}
    best = max(logs, key=logs.get)
    assert got[9]["lang_pred"] == best
    assert abs(got[9]["score"] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-4
