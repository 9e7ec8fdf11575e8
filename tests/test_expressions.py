"""Known answers of the expressions."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tapelab.config import CostModel, Split
from tapelab.functions import costs as C
from tapelab.functions import impact as I
from tapelab.functions import quality as Q
from tapelab.functions.numeric import duration_ms, wilson
from tapelab.functions.scoring import canonical_score, expected_utility
from tapelab.operators.backtest import champion, holdout_verdict
from tapelab.operators.risk import risk_summary
from tapelab.plans.bootstrap import holm

LV = "array<struct<price:double,qty:double>>"


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def levels(*pairs):
    return F.array(*[F.struct(F.lit(float(p)).alias("price"), F.lit(float(q)).alias("qty")) for p, q in pairs])


def test_wilson_edges(spark):
    r = one(spark, a=wilson(F.lit(0), F.lit(0)), b=wilson(F.lit(0), F.lit(50)), c=wilson(F.lit(50), F.lit(50)), d=wilson(F.lit(20), F.lit(100)))
    assert (r.a.lower, r.a.upper) == (0.0, 1.0)
    assert r.b.lower == 0.0 and r.c.upper == pytest.approx(1.0)
    assert r.d.lower < 0.2 < r.d.upper


def test_book_walk_impact(spark):
    df = spark.range(1).select(F.lit(3.0).alias("qty"), F.lit(100.0).alias("price"), F.lit(True).alias("is_buy"), levels((100, 1), (102, 1)).alias("levels"),
                               F.lit(5.0).alias("volatility"), F.lit(500).alias("horizon_ms"))
    o = {k: k for k in ("qty", "price", "is_buy", "levels", "volatility", "horizon_ms")}
    e = df.select(I.estimate("Book-walk", o).alias("e")).first().e
    assert (e.qty, e.price) == (2.0, 101.0)
    assert e.impact_bps == pytest.approx(100.0) and e.reason == "insufficient depth"
    bad = df.withColumn("qty", F.lit(0.0)).select(I.estimate("Square-root", o).alias("e")).first().e
    assert bad.reason == "size must be positive" and bad.qty == 0.0


def leg(price, usd=False, lv=None):
    return C.Leg(F.lit(float(price)), F.lit(0.001), F.lit(0.0001), F.lit(usd), lv)


def test_premium_charged_once_when_lanes_differ(spark):
    m = CostModel(max_btc=1.0, slippage_bps=0.0, latency_bps=0.0, withdrawal_bps=0.0, usdt_premium_bps=10.0, slippage_fallback="zero")
    r = one(spark, same=C.cost_struct(F.lit(1.0), leg(100), leg(100), F.lit(1), m), diff=C.cost_struct(F.lit(1.0), leg(100, True), leg(100), F.lit(1), m))
    assert r.diff.withdrawal - r.same.withdrawal == pytest.approx(0.1)
    assert one(spark, z=C.cost_struct(F.lit(0.0), leg(100), leg(100), F.lit(1), m)).z.total == 0.0


def test_slippage_walk_cap_and_fallback(spark):
    m = CostModel(slippage_bps=1000.0)
    walk = C.walk_slippage(F.lit(2.0), leg(100, lv=levels((100, 1), (101, 1))), True, m)
    cap = C.walk_slippage(F.lit(2.0), leg(100, lv=levels((100, 1), (101, 1))), True, replace(m, slippage_bps=1.0))
    none = C.walk_slippage(F.lit(2.0), leg(100), True, m)
    r = one(spark, walk=walk, cap=cap, none=none)
    assert r.walk == pytest.approx(1.0) and r.cap == pytest.approx(0.02) and r.none == pytest.approx(2.0)


def test_pairs_durations_checksum(spark):
    r = one(spark, a=Q.normal_pair(F.lit(" btc-usdt ")), b=Q.normal_pair(F.lit("eth/btc")), c=duration_ms(F.lit("6h")), d=duration_ms(F.lit("10s")), e=duration_ms(F.lit("5d")),
            f=Q.checksum_digits(F.lit("0.00500000")), g=Q.checksum_digits(F.lit("-1")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("BTC/USD", "ETH/BTC", 21_600_000, 10_000, None, "500000", None)


def test_book_checksum_is_crc32_of_digits(spark):
    import zlib

    lv = lambda *p: F.array(*[F.struct(F.lit(a).alias("price_text"), F.lit(b).alias("qty_text")) for a, b in p])
    r = one(spark, c=Q.book_checksum(lv(("99.5", "2.0")), lv(("100.10", "0.5"))))
    assert r.c == zlib.crc32(b"100105" + b"995" + b"20")


def test_decision_order_and_breaker(spark):
    m = CostModel(min_utility_usd=1.0, min_net_bps=0.5, stale_ms=1000)
    d = lambda q, u, b, l: C.decision(F.lit(q), F.lit(u), F.lit(b), F.lit(l), F.lit(1.0), m)["code"]
    r = one(spark, a=d(0.0, 9.0, 9.0, 1), b=d(1.0, 0.5, 9.0, 1), c=d(1.0, 2.0, 0.1, 1), e=d(1.0, 2.0, 2.0, 2000), f=d(1.0, 2.0, 2.0, 10))
    assert list(r) == ["SKIP_THIN_OR_INVENTORY", "SKIP_MIN_USD", "SKIP_NET_BPS", "SKIP_STALE", "ACCEPT_EXECUTABLE"]
    assert one(spark, x=C.with_breaker(F.lit("ACCEPT_EXECUTABLE"), F.lit(True))).x == "SKIP_CIRCUIT_BREAKER"


def test_level_rules(spark):
    r = one(spark, ok=Q.level_violations(levels((2, 1), (1, 0)), levels((3, 1))), bad=Q.level_violations(levels((1, 1), (2, 1)), levels((3, -1), (2, 1))))
    assert r.ok == [] and set(r.bad) == {"bad_level", "bids_unsorted", "asks_unsorted"}


def test_scores(spark):
    s = canonical_score((1.0, 0.0, 0.0, 0.0, 0.0), F.lit(50.0), F.lit(0), F.lit(1000), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0))
    assert one(spark, s=s).s == pytest.approx(0.5)
    u = expected_utility(F.lit(0.0), F.lit(100.0), F.lit(103.0), F.lit(2.0), F.lit(1.5), F.lit(0.5))
    assert one(spark, u=u).u == pytest.approx(5.0)


def test_split_must_add_up():
    with pytest.raises(ValueError):
        Split(50, 20, 20)
    with pytest.raises(ValueError):
        Split(100, 0, 0)


def test_risk_edges(spark):
    df = spark.createDataFrame([("a", 10, 100), ("b", 10, 100), ("b", -5, 100), ("c", -1, 100), ("c", -1, 100)], "k string, pnl bigint, capital bigint")
    r = {x.k: x for x in risk_summary(df, ["k"]).collect()}
    assert r["a"].sharpe == 0.0 and r["a"].kelly == 1.0
    assert r["c"].kelly == 0.0 and r["c"].sharpe == 0.0 and r["c"].win_probability == pytest.approx(0.25)
    assert r["b"].kelly == pytest.approx(0.5 - 0.5 / 2.0)


def test_champion_and_verdict(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", float("nan"))], "strategy string, objective double")
    assert champion(df).first().strategy == "a"
    v = lambda rows, n: holdout_verdict(spark.createDataFrame(rows, "strategy string, pnl_usd double"), n).first()
    assert v([("a", 0.0), ("b", 0.0)], "a").winner == "empate_inconcluso"
    assert v([("a", 2.0), ("b", 1.0)], "a").champion_won
    assert v([("a", 2.0), ("b", 3.0)], "a").conclusion == "otra_estrategia_supera"
    assert v([("a", float("nan"))], "a").winner == "sin_resultados_validos"


def test_holm(spark):
    df = spark.createDataFrame([("x", 0.04), ("y", 0.01), ("z", 0.03)], "name string, p_value double")
    got = {r["name"]: r.p_holm for r in holm(df).collect()}
    assert got["y"] == pytest.approx(0.03) and got["z"] == pytest.approx(0.06) and got["x"] == pytest.approx(0.06)
