"""Ordered state without a sequential task: trimmed books of delta feeds and average cost of short ledgers."""

import random

import pytest
from pyspark.sql import functions as F
from test_ordered import _brute_books

from tapelab.operators import book
from tapelab.operators.book import rebuild_books
from tapelab.plans.ledger_audit import average_cost

LEVELS = "array<struct<price:double,qty:double>>"


def delta_feed(prices, messages, seed, snapshots=(), remove=0.45):
    rng = random.Random(seed)
    rows = []
    for i in range(messages):
        sides = []
        for sign in (-1, 1):
            mid = 1000 + 20 * ((i * 7 // messages) % 3)
            sides.append([{"price": round(mid + sign * rng.randrange(1, prices) / 100, 2), "qty": 0.0 if rng.random() < remove else float(rng.randrange(1, 9))}
                          for _ in range(rng.randrange(3))])
        rows.append(("v", "p" if i % 3 else "q", i // 2, i, "snapshot" if i in snapshots else "delta", *sides))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, f"venue string, pair string, t bigint, seq bigint, kind string, bids {LEVELS}, asks {LEVELS}")


def books_of(df):
    return {r.seq: [[(round(x.price * 1e8), x.qty) for x in side] for side in (r.bids, r.asks)] for r in df.collect()}


def brute(rows, depth):
    want = {}
    for pair in ("p", "q"):
        want |= _brute_books([r for r in rows if r[1] == pair], depth)
    return want


def test_delta_only_feed_of_5000_prices(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _delta_only_feed(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def _delta_only_feed(spark):
    rows = delta_feed(5000, 3000, 1, remove=0.2)
    d = frame(spark, rows)
    want = brute(rows, 50)
    assert any(len(b[0]) == 50 for b in want.values())
    for parts in (1, 7, 64):
        out = rebuild_books(d, parts=parts)
        assert books_of(out) == want, parts
        tasks = out.groupBy("venue", "pair", F.spark_partition_id().alias("task")).count().groupBy("venue", "pair").count().agg(F.max("count")).first()[0]
        assert parts == 1 or tasks > 1, "a market is in one task"
    assert books_of(rebuild_books(d, strict=True)) == want


@pytest.mark.parametrize("depth,remove,snapshots", [(3, 0.45, ()), (5, 0.7, ()), (8, 0.5, (100, 101, 250)), (2, 0.3, (0,)), (40, 0.55, ())])
def test_books_hang_on_what_was_cut_off(spark, depth, remove, snapshots):
    rows = delta_feed(60, 400, depth, snapshots, remove)
    want = brute(rows, depth)
    for parts in (2, 40):
        assert books_of(rebuild_books(frame(spark, rows), depth=depth, parts=parts)) == want


def test_floor_tells_what_a_start_can_change():
    books = book._Books()
    books.apply(0, [10, 9, 8], [1.0, 1.0, 1.0], 2)
    assert books.keys[0] == [-10, -9] and books.floor == [-9, book.BEHIND]
    books.apply(0, [10], [0.0], 2)
    assert books.floor[0] == -9  # the best it had
    books.clear()
    assert max(books.floor) < -book.BEHIND + 1


def walk(fills):
    stock = cost = real = bad = 0
    for side, q, n, f in fills:
        if side == "buy":
            stock, cost = stock + q, cost + n + f
        elif stock < q:
            bad += 1
        else:
            out = cost * q / stock
            real, stock, cost = real + n - f - out, stock - q, cost - out
    return stock, cost, real, bad


def ledgers(n, seed):
    """Sides at random: stock hovers near zero; ``odd`` quantities never meet; ``once`` goes short at its start only."""
    rng = random.Random(seed)
    out = {}
    for name in ("lots", "odd", "once", "sells"):
        fills = []
        for i in range(n):
            q = rng.randrange(1, 9) * 1.0 if name != "odd" else round(rng.uniform(0.1, 5), 6)
            up = rng.random() < {"lots": 0.5, "odd": 0.5, "once": 0.7 if i > 5 else 0.0, "sells": 0.0}[name]
            fills.append(("buy" if up else "sell", q, q * rng.randrange(90, 110), 1.0))
        out[name] = fills
    return out


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_average_cost_of_short_ledgers(spark, parts):
    fills = ledgers(700, 5)
    rows = [(name, i, s, str(q), n, f) for name, xs in fills.items() for i, (s, q, n, f) in enumerate(xs)]
    d = spark.createDataFrame(rows, "ledger string, sequence bigint, side string, qty string, notional double, fee double").selectExpr("ledger", "sequence", "side", "CAST(qty AS decimal(18,6)) AS qty", "notional", "fee")
    got = {r.ledger: (r.stock, r.cost, r.realized, r.bad_sales) for r in average_cost(d, 100.0, parts).collect()}
    for name, xs in fills.items():
        assert got[name] == pytest.approx(walk(xs), abs=1e-6), name
    assert got["lots"][3] > 10 and got["once"][3] > 0
    assert average_cost(d.where("false")).count() == 0
