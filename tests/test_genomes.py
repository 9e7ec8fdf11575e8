"""Genome scores without a row per trade and genome; frontier and crowding in many tasks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelab.operators import genomes as G


def trades(n=400, seed=3):
    rng = random.Random(seed)
    return [(i // 3, i, rng.choice(["a", "b", "c", None]), rng.random() < 0.2, rng.randrange(1000, 6000), rng.uniform(0.01, 0.5), rng.uniform(90, 110),
             rng.uniform(-3, 4), rng.uniform(-1, 3)) for i in range(n)]


GENOMES = [G.Genome(f"g{i}", w, b, c, lat) for i, (w, b, c, lat) in enumerate([
    (G.WEIGHTS, -500.0, 0.2, 9000), ((1.0, 0.0, 0.0, 0.0, 0.0), 50.0, 0.1, 4000), ((0.2,) * 5, 100.0, 9.0, 3000), ((0.0,) * 5, 0.0, 0.0, 9000), ((0.5, 0.5, 0, 0, 0), 10**9, 1.0, 9000)])]


def brute(rows, g):
    taken = [r for r in rows if r[8] / (r[6] * r[5]) * 1e4 >= g.min_bps and r[4] <= g.max_latency_ms and g.max_btc > 0]
    if not taken:
        return None
    size = [min(r[5], g.max_btc) for r in taken]
    u, e = ([r[k] * s / r[5] for r, s in zip(taken, size)] for k in (7, 8))
    capital = [r[6] * s for r, s in zip(taken, size)]
    path, top, dd = 0.0, 0.0, 0.0
    for x in u:
        path += x
        top = max(top, path)
        dd = max(dd, top - path)
    ret, net = np.divide(u, capital), np.divide(e, capital) * 1e4
    sharpe = float(np.clip(ret.mean() / ret.std(ddof=1), -5, 5)) if len(u) > 1 else 0.0
    sd = max(net.std(ddof=1), 1e-8) if len(u) > 1 else 1.0
    fit = edge = 0.0
    for i, r in enumerate(taken):
        others = [x > 0 for k, x in enumerate(u) if k != i and taken[k][2] == r[2]]
        rel = sum(others) / len(others) if others else 0.5
        w = [max(x, 0) / sum(g.weights) for x in g.weights] if sum(g.weights) > 0 else G.WEIGHTS
        f = (e[i] / 100, 1 - r[4] / max(g.max_latency_ms, 1), size[i] / max(size), rel, (net[i] - net.mean()) / sd / 3)
        p = min(1.0, max(0.0, sum(a * min(1.0, max(0.0, b)) for a, b in zip(w, f))))
        fit += 1 - (p - (u[i] > 0)) ** 2
        edge += (p - 0.5) * math.tanh(u[i] / 25)
    return len(u), sum(u), dd, sharpe, sum(x > 0 for x in u) / len(u), fit / len(u), 0.5 + edge / len(u)


@pytest.mark.parametrize("parts,cells", [(1, 1 << 21), (7, 1)])
def test_population_equals_brute_force(spark, monkeypatch, parts, cells):
    monkeypatch.setattr(G, "ROUTE_CELLS", cells)
    rows = trades()
    ops = spark.createDataFrame(rows, "t long, seq long, route string, partial boolean, latency_ms int, qty double, buy_price double, utility double, expected double")
    pop = G.Population(ops.repartition(3), GENOMES, ["t", "seq"], parts)
    got = {r["genome"]: r for r in pop.windows().join(pop.calibration(), "genome").collect()}
    want = {g.name: brute(rows, g) for g in GENOMES}
    assert set(got) == {k for k, v in want.items() if v} and len(got) == 3
    for name, r in got.items():
        have = (r["trades"], r["pnl"], r["max_drawdown"], r["sharpe"], r["win_rate"], r["calibration"], r["edge"])
        assert have == pytest.approx(want[name], abs=1e-9), name


def test_frontier_and_crowding(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3)).round(1)
    x = np.concatenate([x, x[:40], [[4.0, 4.0 - k / 50, k / 50] for k in range(150)]])
    df = spark.createDataFrame([(i, i % 2, *map(float, r)) for i, r in enumerate(x)], "id long, front int, a double, b double, c double").repartition(5)
    best = {i for i, r in enumerate(x) if not ((x >= r).all(axis=1) & (x > r).any(axis=1)).any()}
    for block in (1 << 16, 20):
        assert {r["id"] for r in G.frontier(df, ("a", "b", "c"), block).collect()} == best
    want = {}
    for front in (0, 1):
        ids = [i for i in range(len(x)) if i % 2 == front]
        for k in range(3):
            order = sorted(ids, key=lambda i: (x[i, k], i))
            span = max(x[order[-1], k] - x[order[0], k], 1e-9)
            for at, i in enumerate(order):
                inner = 0 < at < len(order) - 1
                want[i] = want.get(i, 0.0) + ((x[order[at + 1], k] - x[order[at - 1], k]) / span if inner else math.inf)
    for parts in (1, 9):
        got = {r["id"]: r["crowding"] for r in G.crowding(df, "id", ("a", "b", "c"), parts).collect()}
        assert got == pytest.approx(want)
    assert G.frontier(df.where("false"), ("a", "b", "c")).count() == 0
    assert G.crowding(df.where(F.lit(False)), "id", ("a",)).count() == 0
