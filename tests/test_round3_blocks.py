"""Result blocks of many points over the same routes."""

import random

import pytest
from pyspark.sql import functions as F

from tapelab.operators.ordered import bracketed_percentiles, brackets, drawdown, drawdowns, rank_percentiles
from tapelab.operators.risk import Point, backtest_block, backtest_blocks
from tapelab.plans import lab as LAB


def rounded(df):
    return sorted(tuple(round(x, 9) for x in r) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def routes(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, None]), i // 3, i, rnd.choice([None, 7, *range(-40, 60)]), float(rnd.randrange(-4, 8)), rnd.randrange(1, 40)) for i in range(500)]
    return spark.createDataFrame(rows, "run int, t bigint, seq bigint, pnl bigint, bps double, size bigint")


def test_drawdowns_of_many_columns(routes):
    values = [F.when(F.col("bps") >= m, F.col("pnl")) for m in (-4, 2, 5)]
    got = drawdowns(routes, ["run"], ["t", "seq"], values, 4)
    assert "Generate inline" not in plan_of(got).split("Window")[-1]  # no copies of a row are sorted
    got = {(r.run, r.point): (r.pnl, r.max_drawdown) for r in got.collect()}
    for i, m in enumerate((-4, 2, 5)):
        for r in drawdown(routes.where(F.col("bps") >= m), ["run"], ["t", "seq"], "pnl", 4).collect():
            assert got[r.run, i] == (r.pnl, r.max_drawdown)


def test_exact_quantiles_from_brackets(routes):
    qs = {"lo": 0.05, "mid": 0.5, "hi": 0.95}
    rows = routes.where("run IS NOT NULL")
    want = sorted(map(tuple, rank_percentiles(rows, ["run"], "pnl", qs, parts=4).select("run", *qs).collect()))
    known = rows.groupBy("run").agg(*[c.alias(n) for n, c in brackets(F.col("pnl"), qs).items()])
    wrong = known.withColumn("_at", F.transform("_at", lambda x: F.lit(7).cast("bigint")))
    for bounds in (known, wrong):
        assert sorted(map(tuple, bracketed_percentiles(rows, ["run"], "pnl", bounds, qs, 4).select("run", *qs).collect())) == want


def test_blocks_of_points_are_blocks_of_rows(routes):
    points = [Point({"m": m}, F.col("pnl") - m, F.col("bps") >= m, F.col("bps") - m) for m in (0, 3, 99)]
    got = backtest_blocks(routes, points, ["run"], ["t", "seq"])
    for m in (0, 3, 99):
        one = routes.withColumns({"p": F.col("pnl") - m, "a": F.col("bps") >= m, "b": F.col("bps") - m})
        want = backtest_block(one, ["run"], ["t", "seq"], "p", "a", "b")
        assert rounded(got.where(F.col("m") == m).select(want.columns)) == rounded(want)
    assert backtest_blocks(routes.where("false"), points, [], ["t", "seq"]).count() == 0


def test_presets_are_blocks_of_rules(routes):
    rules = [LAB.Rule("a", 1.0, 10.0), LAB.Rule("b", -1.0, 30.0)]
    got = {r.rule: r for r in LAB.presets(routes.where("run IS NOT NULL"), LAB.points(rules, "pnl", "bps", "size"), ["pnl", "bps", "size"], "run", ["t", "seq"]).collect()}
    assert set(got) == {"a", "b"} and sum(r.best for r in got.values()) == 1
    for rule in rules:
        cut = F.when(F.col("size") > rule.max_size, F.round(F.col("pnl") * rule.max_size / F.col("size")).cast("bigint")).otherwise(F.col("pnl"))
        one = routes.where("run IS NOT NULL").withColumns({"p": cut, "a": F.col("bps") >= rule.min_bps})
        want = backtest_block(one, [], ["t", "seq"], "p", "a", "bps").first()
        assert all(got[rule.name][c] == pytest.approx(want[c]) for c in want.asDict()) and got[rule.name].runs == 2
