"""Which rows the pipeline's stages keep, on planted rows."""

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline as P
from tapelab.llm import language_id
from tapelab.session import stage

SF = "/root/testdata/sf0.001"
OTHER = ["Suomen kieli kuuluu uralilaisiin kieliin ja sitä puhutaan pääasiassa Suomessa sekä Ruotsissa ja Norjassa",
         "A magyar nyelv az uráli nyelvcsalád tagja és a finnugor nyelvek közé tartozik, Magyarországon beszélik",
         "Русский язык является одним из восточнославянских языков и национальным языком русского народа"]


def test_language_drops_gibberish_and_unlearned_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    draw = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    odd = [" ".join("".join(draw.choice(letters, draw.integers(3, 9))) for _ in range(n)) for n in (10, 60, 300)] + OTHER
    planted = spark.createDataFrame([(9000 + i, t, None, "src0", len(t)) for i, t in enumerate(odd)], docs.schema)
    given = docs.unionByName(planted)
    model = language_id.fit(given.where(~language_id.held_out()))
    scores = {r["doc_id"]: r["score"] for r in language_id.predict(planted, model).collect()}
    assert min(scores.values()) > P.LEAST_SCORE  # the posterior alone lets all of them pass
    kept = {r["doc_id"] for r in P.language(spark, given, SF).collect()}
    assert not kept & set(scores)
    assert len(kept) >= docs.count() - 3


def test_one_row_of_a_group_stays_with_null_and_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near, other = text + " more", " ".join(f"else{i}" for i in range(60))
    given = [(5, text), (5, text), (5, near), (None, near), (None, other), (None, other), (7, "alone " * 9), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in given], spark.read.parquet(f"{SF}/documents.parquet").schema)
    out = P.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in out.collect()), key=str)
    assert kept == [(3, ""), (3, ""), (5, "word0"), (7, "alone"), (None, "else0")]


def test_further_columns_come_through(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(9000, "one two three " * 8, "en", None, 96)], schema))
    names = ["score", "lang_pred", "misfit", "n_lines", "kept_text", "_text", "_drops", "_id", "row file", "row number", "place", "size", "quality", "taken",
             "_copy", "_size", "_words", "bucket", "row", "component_id", "further column 7", "mark"]
    docs = stage(docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in names)))
    for name, step in P.STAGES[:-1]:
        out = stage(step(spark, docs, SF))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c} {r['doc_id']}" for c in names), name
        assert step(spark, docs.where("false"), SF).count() == 0
        assert step(spark, stage(docs.where("false")), SF).columns == docs.columns
        docs = out
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0 and P.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
