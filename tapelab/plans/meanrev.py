"""Mean-reversion study of a spread series: AR(1) fit, stationarity tests, threshold rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.operators.backtest import split
from tapelab.operators.ordered import _same, drawdown, ranked, rolling_rows, running_sum
from tapelab.session import stage

INF = float("inf")
# Critical values, candidate (threshold, horizon) pairs, shares of the split.
ADF_5 = -2.86
KPSS_5 = 0.463
CANDIDATES = ((0.75, 1), (1.0, 1), (1.25, 2), (1.5, 3), (2.0, 5))
THRESHOLDS = (0.5, 1.0, 1.5, 2.0)


def with_neighbours(df: DataFrame, keys: list[str], value: str, ahead=(1, 2, 3, 5)) -> DataFrame:
    """Add next values x1, x2, .. of every row; ``rank`` and ``n`` must be there."""
    aggs = {f"x{h}": (lambda w, h=h: F.lead(value, h).over(w)) for h in ahead}
    return rolling_rows(df, keys, ["rank"], aggs, ahead=max(ahead), ready=True)


def ar1(df: DataFrame, keys: list[str], x: str = "x", nxt: str = "x1") -> DataFrame:
    """Least squares of the next value on the value, and the parameters derived from it."""
    f = df.groupBy(*keys).agg(
        F.regr_slope(nxt, x).alias("_b"), F.regr_sxx(nxt, x).alias("sxx"), F.regr_syy(nxt, x).alias("syy"),
        F.regr_avgx(nxt, x).alias("mx"), F.regr_avgy(nxt, x).alias("my"), F.regr_count(nxt, x).alias("pairs"), F.avg(x).alias("mean_x"))
    c = F.col
    f = f.withColumn("beta", F.when((c("pairs") < 2) | (c("sxx") <= 1e-12), 0.0).otherwise(c("_b")))
    f = f.withColumn("alpha", F.when(c("pairs") < 2, 0.0).otherwise(c("my") - c("beta") * c("mx")))
    sse = F.greatest(c("syy") - c("beta") * c("beta") * c("sxx"), F.lit(0.0))
    f = f.withColumn("sigma", F.when(c("pairs") < 2, 0.0).otherwise(F.sqrt(sse / F.greatest(c("pairs") - 2, F.lit(1)))))
    kappa = F.when(c("beta") > 0, -F.ln("beta")).otherwise(INF)
    return f.withColumns({
        "mean": F.when(F.abs(1.0 - c("beta")) > 1e-9, c("alpha") / (1.0 - c("beta"))).otherwise(c("mean_x")),
        "kappa": kappa,
        "half_life": F.when((kappa > 0) & (kappa < INF), 0.6931471805599453 / kappa).otherwise(INF),
        "adf": (c("beta") - 1.0) / F.when(c("sxx") > 1e-12, c("sigma") / F.sqrt("sxx")).otherwise(INF),
    }).withColumn("adf_rejects", c("adf") < ADF_5).drop("_b", "mx", "my", "mean_x")


def kpss(df: DataFrame, keys: list[str], value: str = "x", parts: int | None = None) -> DataFrame:
    """KPSS statistic with Bartlett weights up to floor(sqrt(n)) lags, in linear work.

    The weighted sum of autocovariances equals the sum of squared moving sums of q + 1 residuals
    divided by n (q + 1), moving sums over the edges included. A moving sum is the difference of
    two running sums, so one join on the shifted rank replaces n * sqrt(n) lagged products.
    """
    rows = df if "rank" in df.columns else ranked(df, keys, ["t", "seq"], parts)
    mu = rows.groupBy(*keys).agg(F.avg(value).alias("_mu"))
    rows = _same(rows, mu, keys) if keys else rows.join(F.broadcast(mu))
    rows = rows.select(*keys, "rank", "n", (F.col(value) - F.col("_mu")).alias("_e"))
    rows = running_sum(rows, keys, ["rank"], {"_p": "_e"}, parts)
    q = F.floor(F.sqrt(F.col("n").cast("double")))
    rows = rows.withColumn("_w", q + 1)
    back = rows.select(*keys, (F.col("rank") + F.col("_w")).alias("rank"), F.col("_p").alias("_before"))
    full = rows.join(back, [*keys, "rank"], "left")
    first = F.col("_p") - F.coalesce("_before", F.lit(0.0))
    # windows that reach beyond the end hold what is left of the total, which is zero by construction
    tail = F.when(F.col("rank") >= F.col("n") - F.col("_w"), F.col("_p") * F.col("_p")).otherwise(0.0)
    s = full.groupBy(*keys).agg(
        F.sum(F.col("_p") * F.col("_p")).alias("_num"), F.sum(first * first + tail).alias("_lr"), F.max("n").alias("n"), F.max("_w").alias("_w"))
    n = F.col("n").cast("double")
    stat = F.col("_num") / (n * n) / F.greatest(F.col("_lr") / (n * F.col("_w")), F.lit(1e-12))
    return s.select(*keys, "n", stat.alias("kpss"), (stat < KPSS_5).alias("kpss_accepts"))


def threshold_trades(df: DataFrame, horizon_col: str, mean, limit) -> DataFrame:
    """Rows where the deviation reaches the limit, with the result of betting on its reversal."""
    d = F.col("x") - mean
    r = -F.signum(d) * (F.col(horizon_col) - F.col("x"))
    return df.where(F.col(horizon_col).isNotNull() & (F.abs(d) >= limit)).withColumn("r", r)


def rule_results(trades: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """P&L, trades, win rate and drawdown per key of threshold trades (``r`` along ``rank``)."""
    n = trades.groupBy(*keys).agg(F.count("*").alias("trades"), (F.count_if(F.col("r") > 0) / F.count("*")).alias("win_rate"))
    dd = drawdown(trades, keys, ["rank"], "r", parts)
    return n.join(dd, keys) if keys else n.join(F.broadcast(dd))


def candidate_trades(df: DataFrame, mean: float, sigma: float, candidates=CANDIDATES, keys: list[str] | None = None) -> DataFrame:
    """Trades of every (threshold, horizon) candidate; a row is multiplied by at most five."""
    hits = F.array_compact(F.array(*[
        F.when(
            F.col(f"x{h}").isNotNull() & (F.abs(F.col("x") - mean) >= z * sigma),
            F.struct(F.lit(float(z)).alias("z"), F.lit(h).alias("h"), (-F.signum(F.col("x") - mean) * (F.col(f"x{h}") - F.col("x"))).alias("r")),
        ) for z, h in candidates]))
    return df.select(*(keys or []), "rank", F.inline(hits))


def study(series: DataFrame, order: list[str], parts: int | None = None) -> dict[str, DataFrame]:
    """Estimate on A, choose threshold and horizon on B, judge once on C.

    ``series`` has the order columns and ``x``. Only single rows of parameters reach the driver.
    """
    rows = stage(split(series, order, 50, 20, parts))
    rows = stage(with_neighbours(rows, ["part"], "x"))
    a, b, c = (rows.where(F.col("part") == p) for p in "ABC")
    fit = ar1(a, []).first()
    mean, sigma = fit["mean"], fit["sigma"]
    cal = rule_results(candidate_trades(b, mean, sigma), ["z", "h"], parts).withColumn("objective", F.col("pnl") - 0.35 * F.col("max_drawdown"))
    best = cal.orderBy(F.col("objective").desc(), "z").first()
    z, h = (best["z"], best["h"]) if best else (1.5, 1)
    ou = rule_results(threshold_trades(c, f"x{h}", F.lit(mean), F.lit(z * sigma)), [], parts)
    mean_c = c.agg(F.avg("x")).first()[0]
    simple = rule_results(threshold_trades(c, "x1", F.lit(mean_c), F.lit(sigma)), [], parts)
    none = c.sparkSession.sql("SELECT 0L AS trades, 0D AS win_rate, 0D AS pnl, 0D AS max_drawdown")
    named = [(none, "no_trade"), (simple, "simple_spread_threshold"), (ou, "ou_mean_reversion")]
    hold = None
    for d, name in named:
        d = d.select(F.lit(name).alias("rule"), "trades", "win_rate", "pnl", "max_drawdown")
        hold = d if hold is None else hold.unionByName(d)
    windows = stability(c, z, h, parts)
    tests = a.sparkSession.createDataFrame([(fit["adf"], bool(fit["adf_rejects"]))], "adf double, adf_rejects boolean").join(F.broadcast(kpss(a, [], "x", parts)))
    gate = tests.join(F.broadcast(hold.agg(
        F.max(F.when(F.col("rule") == "ou_mean_reversion", F.col("pnl"))).alias("ou"),
        F.max(F.when(F.col("rule") == "simple_spread_threshold", F.col("pnl"))).alias("simple"))))
    gate = gate.join(F.broadcast(windows.agg(F.count_if(F.col("pnl") > 0).alias("positive_windows"))))
    ok = F.col("adf_rejects") & F.col("kpss_accepts") & (F.col("ou") > F.col("simple")) & (F.col("positive_windows") >= 4)
    ok = F.coalesce(ok, F.lit(False))
    gate = gate.withColumn("decision", F.when(ok, "accepted_for_research_only").otherwise("rejected_by_predeclared_gates"))
    return {"fit": ar1(a, []), "calibration": cal, "holdout": hold, "windows": windows, "decision": gate}


def stability(c: DataFrame, z: float, h: int, parts: int | None = None) -> DataFrame:
    """Refit and trade on five consecutive windows of the holdout."""
    width = F.ceil(F.col("n") / 5)
    w = c.withColumn("window", (F.floor(F.col("rank") / width) + 1).cast("int"))
    w = w.withColumn("_left", F.least(F.col("window") * width, F.col("n")) - F.col("rank"))
    # neighbours beyond the window's end do not count
    cut = w.withColumns({f"x{k}": F.when(F.col("_left") > k, F.col(f"x{k}")) for k in (1, 2, 3, 5)})
    fit = ar1(cut, ["window"])
    rows = cut.join(F.broadcast(fit.select("window", "mean", "sigma", "beta")), "window")  # five rows
    t = threshold_trades(rows, f"x{h}", F.col("mean"), F.col("sigma") * z)
    out = fit.select("window", "beta").join(rule_results(t, ["window"], parts), "window", "left")
    return out.na.fill(0, ["trades", "win_rate", "pnl", "max_drawdown"])


def compact_lab(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Short study on A/B/C rows with ``x``, ``x1``, rank and n: four thresholds, half-sample check."""
    a, b, c = (df.where(F.col("part") == p) for p in "ABC")
    fit = ar1(a, []).first()
    mean, beta, half = fit["mean"], fit["beta"], fit["half_life"]
    sigma = max(a.agg(F.sqrt(F.avg((F.col("x") - mean) * (F.col("x") - mean)))).first()[0] or 0.0, 1e-9)
    picks = [F.coalesce(F.sum(F.when(F.abs(F.col("x") - mean) >= k * sigma, -F.signum(F.col("x") - mean) * (F.col("x1") - F.col("x")))), F.lit(0.0)) for k in THRESHOLDS]
    on_b = b.where("x1 IS NOT NULL").agg(*[p.alias(f"k{i}") for i, p in enumerate(picks)]).first()
    # the last of equal results is kept
    k = max(range(len(THRESHOLDS)), key=lambda i: (on_b[f"k{i}"], i))
    halves = a.withColumn("half", (F.col("rank") >= F.floor(F.col("n") / 2)).cast("int"))
    halves = halves.withColumn("x1", F.when(~((F.col("half") == 0) & (F.col("rank") + 1 >= F.floor(F.col("n") / 2))), F.col("x1")))
    betas = ar1(halves, ["half"]).agg((F.max("beta") - F.min("beta")).alias("gap"))
    d = F.col("x") - mean
    r = F.when(F.abs(d) >= THRESHOLDS[k] * sigma, -F.signum(d) * (F.col("x1") - F.col("x")))
    hold = c.where("x1 IS NOT NULL").agg(
        F.coalesce(F.sum(r), F.lit(0.0)).alias("ou_pnl"), F.count(r).alias("trades"), (F.sum(F.abs(F.col("x1") - F.col("x"))) * 0.05).alias("simple_pnl"))
    out = hold.join(F.broadcast(betas))
    stationary = 0 < beta < 1 and half < INF
    stable = F.col("gap") <= 0.35
    text = (
        F.when(F.lit(not stationary) | ~stable, "rejected_unstable_or_non_stationary")
        .when(F.col("ou_pnl") <= F.col("simple_pnl"), "rejected_does_not_beat_baseline").otherwise("accepted_for_research_only"))
    return out.select(
        F.lit(float(mean)).alias("mean"), F.lit(float(beta)).alias("beta"), F.lit(float(sigma)).alias("sigma"), F.lit(THRESHOLDS[k]).alias("threshold"),
        "gap", "ou_pnl", "trades", "simple_pnl", text.alias("decision"))
