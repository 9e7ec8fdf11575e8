"""The pipeline, stage by stage, against plain Python over the rows each stage was given."""

import functools
import math

import numpy as np
from test_edges import brute_components, brute_lines

import corpus_pipeline as P
from tapelab.llm import language_id, mixing, tokens
from tapelab.session import stage

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_mix(rows):
    """doc_id -> words taken."""
    size = {i: len([w for w in _words(r["text"]) if w]) for i, r in rows.items()}
    names = sorted({r["source"] for r in rows.values()}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole = {s: sum(size[i] for i, r in rows.items() if r["source"] == s) for s in names}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * whole[s] < level * weight[s]}
        if not over:
            break
        target |= {s: 2.0 * whole[s] for s in over}
        left -= sum(2 * whole[s] for s in over)
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    import hashlib
    import re

    taken = {}
    for s in names:
        mine = [i for i, r in rows.items() if r["source"] == s]
        epochs = math.floor(target[s] / whole[s])
        rest = math.floor(target[s] - epochs * whole[s] + 0.5)

        def key(i):
            u = (int(hashlib.md5(f"11:{i}".encode()).hexdigest()[:12], 16) + 1) / 2**48
            t = rows[i]["text"]
            plain = sum(map(len, re.findall("[a-z\x80-\U0010ffff]+", t)))
            return -math.log(u) / (0.1 + (plain / len(t) if t else 0.0))

        for i in sorted(mine, key=key):
            part = max(0, min(size[i], rest))
            rest -= size[i]
            taken[i] = epochs * size[i] + part
    return taken


def _words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@functools.lru_cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "12 34 !!", None, None, 8), (9003, "", "fr", "src2", None)], docs.schema)
    docs = stage(docs.unionByName(extra))
    given, out = rows_of(docs), {}
    for name, step in P.STAGES[:-1]:
        out[name] = stage(step(spark, docs, SF))
        assert out[name].columns == docs.columns
        docs = out[name]

    model = language_id.fit(stage(spark.createDataFrame(list(given.values()), docs.schema)).where(~language_id.held_out()))
    sure = {r["doc_id"] for r in language_id.predict(spark.createDataFrame(list(given.values()), docs.schema), model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    first = rows_of(out["language"])
    assert set(first) == sure and not {9001, 9002, 9003} & sure
    assert all(first[i] == given[i] for i in first) and len(first) >= len(given) - 6

    cut = rows_of(out["line_dedup"])
    assert {i: r["text"] for i, r in cut.items()} == {int(i): t for i, _, _, t in brute_lines([(i, r["text"]) for i, r in first.items()])}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())

    kept = rows_of(out["near_duplicates"])
    groups = brute_components([(i, r["text"]) for i, r in cut.items()], 5, 80, 100)
    assert sorted(map(str, kept)) == sorted(i for i, _, c in groups if i == c)

    taken = brute_mix(kept)
    words = {}
    for r in out["mixture"].collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(_words(r["text"]))
        assert kept[r["doc_id"]]["text"].startswith(r["text"])
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in words.items() if n}
    assert out["mixture"].select(mixing.words("text").alias("n")).groupBy().sum("n").first()[0] == sum(taken.values())

    pieces = P.STAGES[-1][1](spark, docs, SF).collect()
    path = tokens.tokenizer_path("word_bpe_49k.json")
    want = sorted((r["doc_id"], len(library(path).encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == want
    ends = sorted((r["sequence_id"] * 4096 + r["offset"], r["length"]) for r in pieces)
    assert [a for a, _ in ends] == [0, *np.cumsum([n for _, n in ends])[:-1].tolist()] and all(a % 4096 + n <= 4096 for a, n in ends)


def test_run_equals_the_stages(spark):
    rows = P.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100
