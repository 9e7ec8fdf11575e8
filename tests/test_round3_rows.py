"""Execution checks without joins of sides, and sums over frames of rows."""

import random

import pytest
from pyspark.sql import functions as F

from tapelab.catalog import trades
from tapelab.operators.ordered import ranked, rolling_sums
from tapelab.plans import execution_audit as X


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def routes(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, None]), i // 3, i, rnd.choice([None, 7, *range(-40, 60)])) for i in range(500)]
    return spark.createDataFrame(rows, "run int, t bigint, seq bigint, pnl bigint")


def test_wallet_sides_are_grouped_not_joined(spark):
    wallet = "execution_id bigint, venue string, usd bigint, btc bigint, reserved_usd bigint, reserved_btc bigint"
    before = spark.createDataFrame([(1, "A", 100, 5, 0, 0), (2, "A", 100, 5, 0, 0), (3, None, 100, 5, 0, 0)], wallet)
    moved = spark.createDataFrame([(1, "A", 7, 0, 0, 0), (2, "A", 7, 0, 0, 0), (3, None, 7, 0, 0, 0)], wallet)
    after = spark.createDataFrame([(1, "A", 107, 5, 0, 0), (2, "A", 106, 5, 0, 0), (3, None, 107, 5, 0, 0)], wallet)
    reports = spark.createDataFrame([(i, "Reconciled", 0, 1) for i in (1, 2, 3)], "execution_id bigint, state string, residual bigint, releases int")
    fills = spark.createDataFrame([(1, "f", 1, 1)], "execution_id bigint, fill_id string, position bigint, sequence bigint")
    out = X.invariants(reports, before, after, moved, fills)
    assert "FullOuter" not in plan_of(out)
    # an unknown venue is not the same one on two sides
    assert {r.execution_id: (r.ledger_replayed, r.pnl_matches) for r in out.collect()} == {1: (True, True), 2: (False, False), 3: (False, True)}


def test_ranks_of_keys_that_fit_a_task(routes):
    whole, cut = (sorted(map(str, ranked(routes, ["run"], ["t", "seq"], 4, largest=n).collect())) for n in (500, None))
    assert whole == cut


def test_rolling_sums_against_plain_python(spark, routes):
    out = rolling_sums(routes, ["run"], ["t", "seq"], {"s": F.col("pnl"), "k": F.col("pnl").isNotNull().cast("int")}, 7, chunk=20, parts=4)
    seen = {}
    for r in out.orderBy("t", "seq").collect():
        before = seen.setdefault(r.run, [])
        assert (r["rank"], r.s, r.k) == (len(before), sum(v or 0 for v in before[-7:]), sum(v is not None for v in before[-7:]))
        before.append(r.pnl)
    assert "rowframe,-100,-1)" not in plan_of(trades.rolling_zscore(spark, "/root/testdata/sf0.001")).lower().replace(" ", "")  # folded anew for every row
