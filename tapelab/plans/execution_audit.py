"""Audits of two-leg execution reports and their state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.plans.ledger_audit import with_previous

TOLERANCE_BTC = 1e-8
# Allowed state changes (None starts an execution).
EDGES = (
    (None, "Detected"), ("Detected", "Reserved"), ("Reserved", "Leg1Submitted"), ("Leg1Submitted", "Leg1Partial"), ("Leg1Submitted", "Leg1Filled"),
    ("Leg1Partial", "Leg2Submitted"), ("Leg1Partial", "RecoverySelected"), ("Leg1Filled", "Leg2Submitted"), ("Leg1Filled", "RecoverySelected"),
    ("Leg2Submitted", "Leg2Partial"), ("Leg2Submitted", "Leg2Filled"), ("Leg2Submitted", "Leg2Rejected"), ("Leg2Submitted", "Leg2TimedOut"),
    ("Leg2Partial", "RecoverySelected"), ("Leg2Partial", "Reconciled"), ("Leg2Filled", "RecoverySelected"), ("Leg2Filled", "Reconciled"),
    ("Leg2Rejected", "RecoverySelected"), ("Leg2Rejected", "Reconciled"), ("Leg2TimedOut", "RecoverySelected"), ("Leg2TimedOut", "Reconciled"),
    ("RecoverySelected", "Reconciled"))
CHECKS = (
    "terminal", "residual_ok", "btc_conserved", "wallet_equation", "ledger_replayed", "pnl_matches", "fills_unique", "fills_in_order",
    "released_once", "no_negative")


def transition_errors(transitions: DataFrame, parts: int | None = None) -> DataFrame:
    """Steps that are not allowed. Input: execution_id, step, state."""
    rows = with_previous(transitions, ["execution_id"], ["step"], "state", parts)
    edges = transitions.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{a or ''}', '{b}')" for a, b in EDGES) + " AS e(_from, state)")
    rows = rows.withColumn("_from", F.coalesce("before", F.lit("")))
    bad = rows.join(F.broadcast(edges), ["_from", "state"], "left_anti")  # 22 edges
    return bad.select("execution_id", "step", F.col("before").alias("from_state"), "state")


def invariants(reports: DataFrame, before: DataFrame, after: DataFrame, entries: DataFrame, fills: DataFrame) -> DataFrame:
    """Ten checks per execution.

    ``reports``: execution_id, state, residual, releases. Wallets: execution_id, venue, usd, btc,
    reserved_usd, reserved_btc. ``entries``: wallet deltas per venue. ``fills``: fill_id, position,
    sequence. Every check is a grouped sum or a comparison per (execution, venue).
    """
    k = "execution_id"
    cols = ("usd", "btc", "reserved_usd", "reserved_btc")

    c = F.col

    def side(df, p):
        # an unknown execution or venue is not the same one on two sides
        apart = F.when(c(k).isNull() | c("venue").isNull(), F.lit(p))
        return df.select(k, "venue", apart.alias("_side"), *[c(x).alias(f"{p}_{x}") for x in cols])

    sides = {"b": before, "a": after, "d": entries}
    rows = [side(df, p) for p, df in sides.items()]
    w = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    w = w.groupBy(k, "venue", "_side").agg(*[F.sum(f"{p}_{x}").alias(f"{p}_{x}") for p in sides for x in cols])
    w = w.na.fill(0)
    replay = F.lit(True)
    for x in cols:
        replay = replay & (c(f"b_{x}") + c(f"d_{x}") == c(f"a_{x}"))
    nonneg = (c("a_usd") >= 0) & (c("a_btc") >= 0) & (c("a_reserved_usd") >= 0) & (c("a_reserved_btc") >= 0)
    nonneg = nonneg & (c("a_reserved_usd") <= c("a_usd")) & (c("a_reserved_btc") <= c("a_btc"))
    g = w.groupBy(k).agg(
        F.sum("b_usd").alias("bu"), F.sum("a_usd").alias("au"), F.sum("b_btc").alias("bb"), F.sum("a_btc").alias("ab"), F.sum("d_usd").alias("du"),
        F.bool_and(replay).alias("ledger_replayed"), F.bool_and(nonneg).alias("no_negative"),
        F.bool_and((c("a_reserved_usd") == 0) & (c("a_reserved_btc") == 0)).alias("_free"))
    per = fills.groupBy(k, "fill_id").agg(F.count("*").alias("_n"), F.bool_and(c("sequence") == c("position")).alias("_o"))
    f = per.groupBy(k).agg((F.max("_n") == 1).alias("fills_unique"), F.bool_and("_o").alias("fills_in_order"))
    r = reports.join(g, k, "left").join(f, k, "left")
    out = r.select(
        k, (c("state") == "Reconciled").alias("terminal"), (F.abs("residual") <= TOLERANCE_BTC).alias("residual_ok"), (c("bb") == c("ab")).alias("btc_conserved"),
        (c("bb") + c("residual") == c("ab")).alias("wallet_equation"), "ledger_replayed", (c("au") - c("bu") == c("du")).alias("pnl_matches"),
        F.coalesce("fills_unique", F.lit(True)).alias("fills_unique"), F.coalesce("fills_in_order", F.lit(True)).alias("fills_in_order"),
        ((c("releases") == 1) & c("_free")).alias("released_once"), "no_negative")
    out = out.withColumns({x: F.coalesce(x, F.lit(False)) for x in CHECKS})
    all_ok = F.lit(True)
    for x in CHECKS:
        all_ok = all_ok & c(x)
    return out.withColumn("all_passed", all_ok)


def matrix(checks: DataFrame, case: str | None = None) -> DataFrame:
    """Passed and total executions (per case), and whether all passed."""
    return checks.groupBy(*([case] if case else [])).agg(
        F.count("*").alias("total"), F.count_if("all_passed").alias("passed"), F.bool_and("all_passed").alias("all_passed"))


def snapshot_checks(operations: DataFrame, checks: DataFrame, total: int | None = None) -> DataFrame:
    """Named checks of a state snapshot: unique ids, visible within total, recovery invariants."""
    o = operations.groupBy("id").agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("rows"), F.count("*").alias("ids"))
    e = checks.agg(*[F.coalesce(F.bool_and(x), F.lit(False)).alias(x) for x in CHECKS])
    j = o.join(F.broadcast(e))
    c = F.col
    named = [
        ("operationIdsUnique", c("rows") == c("ids")), ("visibleOperationsWithinTotal", c("rows") <= (F.lit(total) if total is not None else c("rows"))),
        ("terminalReconciled", c("terminal")), ("residualBtcZero", c("residual_ok")), ("walletEquation", c("wallet_equation") & c("btc_conserved")),
        ("ledgerReconciled", c("ledger_replayed") & c("pnl_matches")), ("fillsExactlyOnce", c("fills_unique") & c("fills_in_order")),
        ("reservationsReleasedOnce", c("released_once"))]
    return j.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("passed")) for n, v in named])))
