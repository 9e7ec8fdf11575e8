"""Ordered operators against brute force, with hot keys and hot instants, for any bucket count."""

import random

import pytest
from pyspark.sql import functions as F

from tapelab.operators import routes
from tapelab.operators.asof import asof_quotes, latest_by_venue
from tapelab.operators.book import rebuild_books
from tapelab.operators.ordered import bucketed, BUCKET, drawdown, ewma, newest, range_cuts, rank_percentiles, ranked, rolling_rows, running
from tapelab.plans.ledger_audit import average_cost

R = random.Random(7)
# a third of the rows in one instant, two thirds with one key
ROWS = [("hot" if i % 3 else f"k{i % 5}", 1000 if i % 3 == 1 else R.randrange(5000), i, R.randrange(-50, 60)) for i in range(900)]
ORDER = ["t", "seq"]
PARTS = [1, 3, 16]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, t bigint, seq bigint, v bigint").repartition(5)


def by_key():
    out = {}
    for r in sorted(ROWS, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_hot_instant_is_split(spark, df):
    cuts = range_cuts(df, ORDER, 12)
    sizes = [r["count"] for r in bucketed(df, ORDER, cuts=cuts).groupBy(BUCKET).count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 900 // 6


@pytest.mark.parametrize("parts", PARTS)
def test_rank_and_running(df, parts):
    want = {}
    for k, rows in by_key().items():
        s, top = 0, None
        for i, r in enumerate(rows):
            s += r[3]
            want[r[2]] = (i, len(rows), s, top)
            top = r[3] if top is None else max(top, r[3])
    a = {r.seq: (r["rank"], r.n) for r in ranked(df, ["k"], ORDER, parts).collect()}
    b = {r.seq: r.s for r in running(df, ["k"], ORDER, {"s": ("sum", "v")}, parts).collect()}
    c = {r.seq: r.m for r in running(df, ["k"], ORDER, {"m": ("max", "v")}, parts, exclusive=True).collect()}
    assert all((a[q][0], a[q][1], b[q], c[q]) == w for q, w in want.items()) and len(a) == len(ROWS)


@pytest.mark.parametrize("parts", PARTS)
def test_drawdown(df, parts):
    for k, rows in by_key().items():
        p = peak = dd = 0
        for r in rows:
            p += r[3]
            peak = max(peak, p)
            dd = max(dd, peak - p)
        got = drawdown(df.where(F.col("k") == k), ["k"], ORDER, "v", parts).first()
        assert (got.pnl, got.max_drawdown) == (p, dd)


@pytest.mark.parametrize("parts", PARTS)
def test_ewma(df, parts):
    got = {r.k: r.ewma for r in ewma(df, ["k"], ORDER, "v", 0.1, parts=parts).collect()}
    for k, rows in by_key().items():
        x = None
        for r in rows:
            x = r[3] if x is None else x * 0.9 + r[3] * 0.1
        assert got[k] == pytest.approx(x)


@pytest.mark.parametrize("parts", PARTS)
def test_percentiles_and_newest(df, parts):
    got = {r.k: (r.p5, r.p95, r.fl) for r in rank_percentiles(df, ["k"], "v", {"p5": 0.05, "p95": 0.95}, parts=parts).join(
        rank_percentiles(df, ["k"], "v", {"fl": 0.5}, rule="floor", parts=parts), "k").collect()}
    top = {}
    for r in newest(df, ["k"], ORDER, 7, parts).collect():
        top.setdefault(r.k, set()).add((r.newest, r.seq))
    for k, rows in by_key().items():
        v = sorted(r[3] for r in rows)
        at = lambda q: v[int((len(v) - 1) * q + 0.5)]
        assert got[k] == (at(0.05), at(0.95), v[min(int(len(v) * 0.5), len(v) - 1)])
        assert top[k] == {(i + 1, r[2]) for i, r in enumerate(rows[::-1][:7])}


@pytest.mark.parametrize("chunk", [1, 10, 100000])
def test_rolling_rows(df, chunk):
    out = rolling_rows(df, ["k"], ORDER, {"s": lambda w: F.sum("v").over(w.rowsBetween(-3, 2))}, back=3, ahead=2, chunk=chunk, parts=4)
    got = {r.seq: r.s for r in out.collect()}
    for rows in by_key().values():
        for i, r in enumerate(rows):
            assert got[r[2]] == sum(x[3] for x in rows[max(0, i - 3):i + 3])


@pytest.mark.parametrize("parts", PARTS)
def test_asof(spark, df, parts):
    q = df.select(F.lit("P").alias("pair"), F.col("k").alias("venue"), "t", "seq", F.col("v").alias("bid"))
    got = {r.seq: {x.venue: x.seq for x in r.latest} for r in latest_by_venue(q, ["bid"], parts=parts).collect()}
    state, want = {}, {}
    for r in sorted(ROWS, key=lambda r: (r[1], r[2])):
        state[r[0]] = r[2]
        want[r[2]] = dict(state)
    assert got == want
    probes = spark.createDataFrame([(i, "hot", i * 37) for i in range(150)], "id bigint, venue string, t bigint")
    one = {r.id: r.quote and r.quote.seq for r in asof_quotes(probes, q, ["bid"], ["venue"], parts=parts).collect()}
    hot = by_key()["hot"]
    for i in range(150):
        before = [r for r in hot if r[1] <= i * 37]
        assert one[i] == (before[-1][2] if before else None)


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("wait", [1, 40, 900, 10000])
def test_cooldown(df, parts, wait):
    got = {}
    for r in routes.cooldown(df, ["k"], "t", wait, parts).collect():
        got.setdefault(r.k, set()).add(r.t)
    for k, rows in by_key().items():
        last, keep = None, set()
        for r in rows:
            if last is None or r[1] - last >= wait:
                last = r[1]
                keep.add(last)
        assert got[k] == keep


def test_disjoint_batch(spark):
    rows = [(1, "A", "B", 9.0), (1, "A", "C", 8.0), (1, "D", "B", 7.0), (1, "D", "C", 6.0), (2, "A", "C", 1.0)]
    d = spark.createDataFrame(rows, "tick int, buy string, sell string, score double").withColumn("route", F.concat_ws("->", "buy", "sell"))
    got = {(r.tick, r.route) for r in routes.disjoint_batch(d, ["tick"], "buy", "sell").collect()}
    assert got == {(1, "A->B"), (1, "D->C"), (2, "A->C")}


@pytest.mark.parametrize("parts", PARTS)
def test_average_cost(spark, parts):
    rows, want = [], {}
    for led in ("clean", "short"):
        stock = cost = real = bad = 0.0
        for i in range(1, 120):
            q, price = R.randrange(1, 9), R.randrange(90, 110)
            buy = (R.random() < 0.4 or stock < q) if led == "clean" else R.random() < 0.5
            rows.append((led, i, "buy" if buy else "sell", q, q * price, 1))
            if buy:
                stock, cost = stock + q, cost + q * price + 1
            elif stock < q:
                bad += 1
            else:
                out = cost * q / stock
                real, stock, cost = real + q * price - 1 - out, stock - q, cost - out
        want[led] = (stock, cost, real, bad)
    d = spark.createDataFrame(rows, "ledger string, sequence bigint, side string, qty bigint, notional bigint, fee bigint")
    got = {r.ledger: (r.stock, r.cost, r.realized, r.bad_sales) for r in average_cost(d, 100.0, parts).collect()}
    assert want["short"][3] > 0
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-6)


def _messages():
    out = []
    for i in range(240):
        side = [(100 - R.randrange(1, 40) / 10, R.choice([0, 0, 1, 2])) for _ in range(3)], [(100 + R.randrange(1, 40) / 10, R.choice([0, 0, 1, 2])) for _ in range(3)]
        out.append(("v", "p", i // 2, i, "snapshot" if i % 70 == 0 else "delta", *[[{"price": p, "qty": float(q)} for p, q in s] for s in side]))
    return out


def _brute_books(rows, depth):
    book, want = [{}, {}], {}
    for r in rows:
        if r[4] == "snapshot":
            book = [{}, {}]
        for s in (0, 1):
            for x in r[5 + s]:
                k = round(x["price"] * 1e8)
                book[s].pop(k, None) if x["qty"] == 0 else book[s].__setitem__(k, x["qty"])
            keep = sorted(book[s], reverse=s == 0)[:depth]
            book[s] = {k: book[s][k] for k in keep}
        want[r[3]] = [list(b.items()) for b in book]
    return want


@pytest.mark.parametrize("depth,starts", [(50, 70), (3, 70), (3, 10**9), (12, 40)])
def test_books_do_not_depend_on_the_buckets(spark, depth, starts):
    rows = [(*r[:4], "snapshot" if i % starts == 0 else "delta", *r[5:]) for i, r in enumerate(_messages())]
    lv = "array<struct<price:double,qty:double>>"
    d = spark.createDataFrame(rows, f"venue string, pair string, t bigint, seq bigint, kind string, bids {lv}, asks {lv}")
    want = _brute_books(rows, depth)
    for kw in ({"parts": 1}, {"parts": 2}, {"parts": 7}, {"parts": 64}, {"strict": True, "parts": 3}):
        got = {r.seq: [[(round(x.price * 1e8), x.qty) for x in side] for side in (r.bids, r.asks)] for r in rebuild_books(d, depth=depth, **kw).collect()}
        assert got == want, kw


def test_trim_keeps_the_best(spark):
    lv = "array<struct<price:double,qty:double>>"
    bids = [{"price": float(i), "qty": 1.0} for i in range(60, 0, -1)]
    d = spark.createDataFrame([("v", "p", 1, 1, "snapshot", bids, [{"price": 70.0, "qty": 1.0}])], f"venue string, pair string, t bigint, seq bigint, kind string, bids {lv}, asks {lv}")
    r = rebuild_books(d).first()
    assert len(r.bids) == 50 and r.bid == 60.0 and r.bids[-1].price == 11.0


@pytest.mark.parametrize("parts", PARTS)
def test_analyses_of_a_replay(spark, parts):
    from tapelab.operators.replay import analyses, replay_clock

    rng = random.Random(9)
    times, now = [], 1000
    for i in range(300):
        now += rng.choice([0, 0, 1, 40, 90, 249, 250, 251, -30, 700])
        times.append((i, now))
    want, clock, last = [], None, None
    for i, t in times:
        clock = t if clock is None or t > clock else clock + 1
        if last is None or clock - last >= 250 or i == len(times) - 1:
            want.append(clock)
            last = clock
    d = spark.createDataFrame(times, "seq bigint, ms bigint")
    got = analyses(replay_clock(d, "ms", ["seq"], parts=parts), parts=parts)
    assert sorted(r["clock"] for r in got.collect()) == want
    assert analyses(replay_clock(d.where("false"), "ms", ["seq"], parts=parts)).count() == 0


def test_candidates_rank_by_score_per_tick(spark):
    from tapelab.operators.routes import rank_candidates

    rows = [(i % 3 if i % 2 else 0, i, None if i % 11 == 0 else float(i * 7 % 5), i % 4 != 0) for i in range(200)]
    df = spark.createDataFrame(rows, "tick long, seq long, score double, executable boolean").withColumn("rank", F.lit(9)).repartition(3)
    want = {}
    for tick in (0, 1, 2):
        mine = sorted((r for r in rows if r[0] == tick and r[3]), key=lambda r: (r[2] is None, -(r[2] or 0.0), r[1]))
        want |= {r[1]: k + 1 for k, r in enumerate(mine)}
    for parts in (1, 7):
        got = {r.seq: r.position for r in rank_candidates(df, ["tick"], "score", ["seq"], parts).collect()}
        assert got == want
