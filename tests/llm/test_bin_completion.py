"""Best-fit packing: exact round trip, and the number of sequences against the least possible one."""

import random
import zlib
from collections import Counter

import numpy as np
from test_brute_force import odd_docs, whole

from tapelab.llm import bin_completion as B
from tapelab.llm import tokens


def optimum(pieces, capacity):
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for j, r in enumerate(rooms):
            if r >= pieces[i] and r not in rooms[:j]:
                rooms[j] -= pieces[i]
                go(i + 1, rooms)
                rooms[j] += pieces[i]
        rooms.append(capacity - pieces[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def test_plans_need_the_fewest_sequences():
    rng = random.Random(2)
    better = 0
    for t in range(150):
        capacity = rng.choice([10, 50, 100])
        low, high = ((1, capacity), (capacity // 5, capacity // 2 + 1))[t % 2]
        pieces = [rng.randint(low, high) for _ in range(rng.randrange(1, 13))]
        counts = Counter(pieces)
        got, n = Counter(), 0
        for pattern, copies in B.plan(counts, capacity):
            assert sum(s * k for s, k in pattern) <= capacity and copies > 0
            n += copies
            for s, k in pattern:
                got[s] += k * copies
        least = optimum(pieces, capacity)
        assert got == counts and n == least >= B.lower_bound(counts, capacity)
        better += B.best_fit(counts, capacity).total() > n
    assert better  # branch and bound found what best fit missed


def test_plans_of_many_pieces():
    rng = np.random.default_rng(0)
    for sizes in (np.clip(rng.lognormal(6.5, 1, 10**5).astype(int), 1, 2048), rng.choice([700, 701, 650, 333, 2048], 10**6)):
        counts = Counter(sizes.tolist())
        fitted, made = B.best_fit(counts, 2048).total(), B.plan(counts, 2048)
        assert B.lower_bound(counts, 2048) <= sum(n for _, n in made) <= fitted
        # twice the documents take no more patterns to speak of
        assert len(B.plan({s: 1000 * n for s, n in counts.items()}, 2048)) < 2 * len(made) + 50
    assert B.plan({}, 2048) == [] and B.lower_bound({}, 2048) == 0


def test_pieces_come_back(spark):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    docs = odd_docs(spark)
    for window in (64, 2048):
        rows = B.pack(docs, path, window=window).collect()
        held = {}
        for r in rows:
            assert 0 < r["length"] <= window and len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
            assert r["start"] == r["piece"] * window
            held.setdefault(r["sequence_id"], []).append(r)
        for pieces in held.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= window
        assert sorted(held) == list(range(len(held)))
        counts = Counter(r["length"] for r in rows)
        assert len(held) <= B.best_fit(counts, window).total()
        want = Counter()
        for r in docs.collect():
            ids = whole(path, r["text"] or "") + [0]
            for piece, start in enumerate(range(0, len(ids), window)):
                want[(r["doc_id"], piece, tuple(ids[start:start + window]))] += 1
        assert Counter((r["doc_id"], r["piece"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    digest = B.digest(docs.selectExpr("*", "1 AS piece", "2 AS length", "'x' AS place"), path)
    assert digest.count() > 0 and "ids" not in digest.columns
    assert B.pack(docs.where("false"), path).count() == 0
