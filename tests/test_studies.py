"""Studies that have no SQL twin, against plain Python over the same rows."""

import json
import math
import random
from dataclasses import replace

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tapelab import bindings as B
from tapelab.config import GRID_IMPACTS, GRID_SCORES, GRID_THRESHOLDS, STRATEGIES
from tapelab.operators import backtest as BT
from tapelab.operators.replay import replay_clock
from tapelab.plans import evaluate as EV
from tapelab.plans import health as H
from tapelab.plans import meanrev as MR
from tapelab.plans import microstructure as MS
from tapelab.sources import exports as EX

near = lambda v: pytest.approx(v, rel=1e-7, abs=1e-7)


def parts_of(xs):
    a = len(xs) // 2
    b = a + len(xs) * 20 // 100
    return xs[:a], xs[a:b], xs[b:]


def line(xs):
    """Least squares of the next value on the value: alpha, beta, sigma, sum of squares of x."""
    x, y = xs[:-1], xs[1:]
    n, mx, my = len(x), sum(x) / len(x), sum(y) / len(x)
    sxx = sum((v - mx) ** 2 for v in x)
    beta = sum((v - mx) * (w - my) for v, w in zip(x, y)) / sxx
    alpha = my - beta * mx
    sse = sum((w - alpha - beta * v) ** 2 for v, w in zip(x, y))
    return alpha, beta, math.sqrt(sse / max(n - 2, 1)), sxx


def bets(xs, h, mean, limit):
    return [-math.copysign(1, xs[i] - mean) * (xs[i + h] - xs[i]) for i in range(len(xs) - h) if abs(xs[i] - mean) >= limit]


def deepest(rs):
    total = top = down = 0.0
    for r in rs:
        total += r
        top = max(top, total)
        down = max(down, top - total)
    return down


def measures(rs):
    return len(rs), sum(r > 0 for r in rs) / len(rs) if rs else 0.0, sum(rs), deepest(rs)


def kpss(xs):
    n, mu = len(xs), sum(xs) / len(xs)
    e = [x - mu for x in xs]
    q, total, num = math.isqrt(n), 0.0, 0.0
    for v in e:
        total += v
        num += total * total
    lr = sum(v * v for v in e) / n
    for lag in range(1, q + 1):
        lr += 2 * (1 - lag / (q + 1)) * sum(e[i] * e[i - lag] for i in range(lag, n)) / n
    return num / (n * n) / max(lr, 1e-12)


def series(seed, beta, n=900):
    rnd, x, out = random.Random(seed), 0.0, []
    for _ in range(n):
        x = beta * x + rnd.gauss(0.1, 1.0)
        out.append(x)
    return out


@pytest.mark.parametrize("seed, beta", [(1, 0.4), (2, 0.97)])
def test_mean_reversion_study(spark, seed, beta):
    xs = series(seed, beta)
    df = spark.createDataFrame([(i // 3, i, x) for i, x in enumerate(xs)], "t bigint, seq bigint, x double").repartition(4)
    got = MR.study(df, ["t", "seq"], parts=5)
    a, b, c = parts_of(xs)
    alpha, slope, sigma, sxx = line(a)
    mean = alpha / (1 - slope)
    want = []
    for z, h in MR.CANDIDATES:
        trades, rate, pnl, dd = measures(bets(b, h, mean, z * sigma))
        if trades:
            want.append((z, h, trades, rate, pnl, dd))
    cal = sorted((r.z, r.h, r.trades, r.win_rate, r.pnl, r.max_drawdown) for r in got["calibration"].collect())
    assert [r[:3] for r in cal] == [w[:3] for w in want]
    assert [v for r in cal for v in r[3:]] == near([v for w in want for v in w[3:]])
    z, h = max(want, key=lambda w: (w[4] - 0.35 * w[5], -w[0]))[:2]
    rules = {
        "no_trade": (0, 0.0, 0.0, 0.0), "simple_spread_threshold": measures(bets(c, 1, sum(c) / len(c), sigma)),
        "ou_mean_reversion": measures(bets(c, h, mean, z * sigma))}
    hold = {r.rule: (r.trades, r.win_rate, r.pnl, r.max_drawdown) for r in got["holdout"].collect()}
    assert hold.keys() == rules.keys()
    for name, row in rules.items():
        assert hold[name] == near(row), name
    width = -(-len(c) // 5)
    wins = []
    for k in range(5):
        part = c[k * width:(k + 1) * width]
        al, be, si, _ = line(part)
        wins.append((k + 1, be, *measures(bets(part, h, al / (1 - be), z * si))))
    rows = sorted((r.window, r.beta, r.trades, r.win_rate, r.pnl, r.max_drawdown) for r in got["windows"].collect())
    assert [v for r in rows for v in r] == near([v for w in wins for v in w])
    d = got["decision"].first()
    adf, stat = (slope - 1) / (sigma / math.sqrt(sxx)), kpss(a)
    assert (d.adf, d.kpss) == near((adf, stat))
    ok = adf < -2.86 and stat < 0.463 and rules["ou_mean_reversion"][2] > rules["simple_spread_threshold"][2] and sum(w[4] > 0 for w in wins) >= 4
    assert d.decision == ("accepted_for_research_only" if ok else "rejected_by_predeclared_gates")


@pytest.mark.parametrize("seed, beta", [(3, 0.4), (4, -0.3)])
def test_compact_lab(spark, seed, beta):
    xs = series(seed, beta)
    df = spark.createDataFrame([(i // 3, i, x) for i, x in enumerate(xs)], "t bigint, seq bigint, x double").repartition(4)
    rows = MR.with_neighbours(BT.split(df, ["t", "seq"], 50, 20, 5), ["part"], "x", (1,))
    got = MR.compact_lab(rows, 5).first()
    a, b, c = parts_of(xs)
    alpha, slope, _, _ = line(a)
    mean = alpha / (1 - slope)
    sigma = max(math.sqrt(sum((x - mean) ** 2 for x in a) / len(a)), 1e-9)
    k = max(MR.THRESHOLDS, key=lambda k: (sum(bets(b, 1, mean, k * sigma)), k))
    trades = bets(c, 1, mean, k * sigma)
    simple = sum(abs(y - x) for x, y in zip(c, c[1:])) * 0.05
    gap = abs(line(a[:len(a) // 2])[1] - line(a[len(a) // 2:])[1])
    assert (got.mean, got.beta, got.sigma, got.threshold, got.gap, got.ou_pnl, got.trades, got.simple_pnl) == near((mean, slope, sigma, k, gap, sum(trades), len(trades), simple))
    text = "rejected_unstable_or_non_stationary" if not 0 < slope < 1 or gap > 0.35 else "accepted_for_research_only" if sum(trades) > simple else "rejected_does_not_beat_baseline"
    assert got.decision == text


def run_rule(rows, s):
    """Results of one rule over candidates in order: (fills, P&L, drawdown, profit factor)."""
    trades = []
    clip = lambda v, lo, hi: max(lo, min(hi, v))
    for r in rows:
        net = r.gross_bps - r.cost_bps * s.impact
        f = (clip(net / 10, -1, 1), clip(1 - r.latency_ms / 10000, 0, 1), clip(r.available / 0.5, 0, 1), float(r.realized_bps >= 0), clip(abs(r.gross_bps) / 20, 0, 1))
        score = sum(w * v for w, v in zip(s.weights, f)) / max(sum(s.weights), 1e-9)
        size = min(s.max_btc * clip(net / 20, 0, 0.5) if s.sizing == "kelly" else s.max_btc, r.available)
        if r.available <= 0 or r.latency_ms > s.latency_ms or net < s.threshold_bps or score < s.score_floor or size <= 0:
            continue
        capital = r.ask * size
        trades.append(capital * (r.gross_bps + r.realized_bps) / 10000 - capital * r.cost_bps * s.impact / 10000)
    gain, loss = sum(t for t in trades if t >= 0), -sum(t for t in trades if t < 0)
    return len(trades), sum(trades), deepest(trades), gain / loss if loss > 0 else math.inf if gain > 0 else 0.0


def test_walk_forward_evaluation(spark):
    model = replace(B.MODEL, slippage_fallback="zero")
    quotes, venues = B.quotes(spark, SF), B.venues(spark)
    rows = EV.candidate_parts(quotes, venues, model, by_pair=False).orderBy("part", "rank").collect()
    b, c = ([r for r in rows if r.part == p] for p in "BC")
    points = [(t, i, f) for t in GRID_THRESHOLDS for i in GRID_IMPACTS for f in GRID_SCORES]
    best, held = {}, {}
    for s in STRATEGIES:
        runs = [run_rule(b, replace(s, threshold_bps=t, impact=i, score_floor=f)) for t, i, f in points]
        score = [round(pnl - 0.35 * dd, 9) for _, pnl, dd, _ in runs]
        k = max(range(len(points)), key=lambda k: (score[k], round(runs[k][3], 9), -k))
        t, i, f = points[k]
        best[s.name] = (k, score[k])
        held[s.name] = run_rule(c, replace(s, threshold_bps=t, impact=i, score_floor=f))
    chosen = min(best, key=lambda n: (-best[n][1], n))
    got = EV.evaluate(quotes, venues, model, by_pair=False)
    assert {r.strategy: (r.point, round(r.objective, 6)) for r in got["calibration"].collect()} == {n: (k, round(v, 6)) for n, (k, v) in best.items()}
    assert got["champion"].first().strategy == chosen
    for r in got["holdout"].collect():
        assert (r.filled, r.pnl_usd, r.max_drawdown_usd) == near(held[r.strategy][:3]), r.strategy
    top = max(v[1] for v in held.values())
    lead = [n for n, v in held.items() if abs(top - v[1]) <= max(abs(top) * 1e-9, 1e-9)]
    v = got["verdict"].first()
    assert v.winner == (lead[0] if len(lead) == 1 else "empate_inconcluso")
    assert v.champion_won == (lead == [chosen])


def pooled(rows):
    """Non-decreasing steps through (p, label): [upper end, mean label]."""
    at = {}
    for p, y in rows:
        n, k = at.get(p, (0, 0))
        at[p] = (n + 1, k + y)
    blocks = []
    for p in sorted(at):
        n, k = at[p]
        blocks.append([p, n, k])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            p, n, k = blocks.pop()
            blocks[-1] = [p, n + blocks[-1][1], k + blocks[-1][2]]
    return [(p, k / n) for p, n, k in blocks]


def test_calibrated_models_and_transfer(spark):
    """Fits on part B judged on part C, over all rows and by venue."""
    quotes = B.quotes(spark, SF, levels=True).withColumns({"t": F.expr("t div 1000"), "latency_ms": F.col("latency_ms") / 10.0})
    rows = BT.split(MS.samples(quotes), MS.ORDER, 50, 20).select("part", "venue", "raw", "filled").collect()
    b = [(r.raw, float(r.filled)) for r in rows if r.part == "B"]
    c = [r for r in rows if r.part == "C"]
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    logit = lambda p: math.log(clip(p) / (1 - clip(p)))
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    slope, shift, xs = 1.0, 0.0, [(logit(p), y) for p, y in b]
    for _ in range(800):
        err = [sigmoid(slope * x + shift) - y for x, y in xs]
        slope, shift = slope - 0.08 * sum(e * x for e, (x, _) in zip(err, xs)) / len(xs), shift - 0.08 * sum(err) / len(xs)
    steps = pooled(b)
    models = {
        "raw": lambda p: p, "platt": lambda p: sigmoid(slope * logit(p) + shift),
        "isotonic": lambda p: next((v for end, v in steps if end >= p), steps[-1][1])}

    def judged(part, model):
        ps = [(models[model](r.raw), r.filled) for r in part]
        bounded = [(min(max(p, 1e-9), 1 - 1e-9), y) for p, y in ps]
        return len(ps), sum((p - y) ** 2 for p, y in ps) / len(ps), -sum(math.log(p if y else 1 - p) for p, y in bounded) / len(ps)

    got = MS.study(quotes)
    loose = lambda v: pytest.approx(v, rel=1e-5, abs=1e-5)
    for r in got["metrics"].collect():
        assert (r.observations, r.brier, r.log_loss) == loose(judged(c, r.model)), r.model
    transfer = got["transfer"].collect()
    assert {(r.venue, r.model) for r in transfer} == {(r.venue, m) for r in c for m in ("platt", "isotonic")}
    for r in transfer:
        assert (r.observations, r.brier, r.log_loss) == loose(judged([x for x in c if x.venue == r.venue], r.model)), (r.venue, r.model)


def test_replay_summary(spark):
    ms = [0, 0, 100, 90, 251, 251, 1000]
    ticks = spark.createDataFrame([(m, i, float(i)) for i, m in enumerate(ms)], "ms bigint, seq bigint, bid double")
    trades = spark.createDataFrame([(5,), (-2,), (4,)], "pnl bigint")
    clocked = lambda d: replay_clock(d, "ms", ["seq"], parts=3).drop("rank", "n")
    got = H.replay_summary(clocked(ticks), trades).first()
    clock, cells = -1, set()
    for m in ms:
        clock = max(clock + 1, m)
        cells.add(clock // 250)
    assert (got.ticks, got.cycles, got.operations, got.pnl) == (7, len(cells), 3, 7)
    again = H.replay_summary(clocked(ticks.repartition(5)), trades).first()
    other = H.replay_summary(clocked(ticks.withColumn("bid", F.when(F.col("seq") == 3, 9.0).otherwise(F.col("bid")))), trades).first()
    assert (again.low, again.high) == (got.low, got.high) != (other.low, other.high)
    none = H.replay_summary(clocked(ticks.where("false")), trades.where("false")).first()
    assert (none.ticks, none.cycles, none.operations, none.pnl) == (0, 0, 0, 0)


def test_fingerprints(spark):
    d = spark.createDataFrame([(i % 50, str(i % 5)) for i in range(200)], "k bigint, v string")
    mark = lambda x: EX.table_fingerprint(x).first()
    base = mark(d)
    assert base.rows == 200
    assert mark(d.repartition(7)) == base == mark(d.select("v", "k"))  # neither rows nor columns have an order
    assert mark(d.dropDuplicates()) != base  # repeats count
    assert mark(d.withColumn("v", F.when(F.col("k") == 3, None).otherwise(F.col("v")))) != base


def test_report_rows(spark):
    model = replace(B.MODEL, slippage_fallback="zero")
    c = EV.candidate_parts(B.quotes(spark, SF), B.venues(spark), model, by_pair=False).where("part = 'C'")
    runs = BT.backtest(c, [BT.Run(s, 0) for s in STRATEGIES])
    runs = runs.withColumn("profit_factor", F.when(F.col("strategy") == "tamano_fijo", float("inf")).otherwise(F.col("profit_factor")))
    want = {r.strategy: r for r in runs.collect()}
    rows = EX.report_rows(runs).collect()
    assert {r.strategy for r in rows} == set(want) and tuple(rows[0].asDict()) == EX.REPORT
    for r in rows:
        w = want[r.strategy]
        assert r.pnl_net_usd == f"{w.pnl_usd:.8f}" and r.turnover_usd == f"{w.turnover:.8f}" and r.negative_windows == str(w.negative_windows)
        assert r.profit_factor == ("inf" if math.isinf(w.profit_factor) else f"{w.profit_factor:.8f}")
        assert r.rejections_by_cause == json.dumps(dict(sorted(w.rejections.items())), separators=(",", ":"))
