"""Scoring and ranking of candidate parameter vectors on recorded trades (no search loop)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.config import WEIGHTS
from tapelab.functions.numeric import clamp, ratio
from tapelab.operators.ordered import _same, drawdown, fold_drawdown, rank_percentiles, running
from tapelab.session import default_parts, stage

RIVALS = 512  # compared at a time
FRONTIER_BLOCK = 1 << 16
OBJECTIVES = ("o_pnl", "o_sharpe", "o_drawdown", "o_win_rate")


@dataclass(frozen=True)
class Genome:
    """A rule set: weights, entry threshold, size cap, latency limit. Defaults: the frozen champion."""

    name: str
    weights: tuple = WEIGHTS
    min_bps: float = 0.65
    max_btc: float = 0.18
    max_latency_ms: int = 4500


def selected(ops: DataFrame, genomes: list[Genome]) -> DataFrame:
    """Trades each of a few genomes would have taken, scaled to its size cap; for many see :class:`Population`.

    Input: buy_price, qty, utility, expected, latency_ms, partial, route. A genome that does not
    take a trade makes no row, and the trades are read once for all genomes.
    """
    c = F.col
    capital = c("buy_price") * c("qty")
    net = c("expected") / capital * 10000.0
    base = ops.where((capital > 0) & (c("qty") > 0)).withColumn("net_bps", net)
    picks = [
        F.when(
            (c("net_bps") >= g.min_bps) & (c("latency_ms") <= g.max_latency_ms) & (F.lit(g.max_btc) > 0),
            F.struct(F.lit(g.name).alias("genome"), F.least(c("qty"), F.lit(g.max_btc)).alias("size"), F.lit(g.max_latency_ms).alias("tolerance"),
                     F.array(*[F.lit(float(w)) for w in g.weights]).alias("weights")))
        for g in genomes]
    df = base.withColumn("_g", F.explode(F.array_compact(F.array(*picks)))).select(*base.columns, "_g.*")
    scale = c("size") / c("qty")
    return df.withColumns({"u": c("utility") * scale, "e": c("expected") * scale, "capital": c("buy_price") * c("size")})


_TRADE = ["route", "partial", "latency_ms", "qty", "buy_price", "utility", "expected"]
_WINDOW = ("trades", "won", "partials", "latency", "mean", "r_count", "r_mean", "r_m2", "n_mean", "n_m2", "largest", "s", "hi", "lo", "dd")
ROUTE_CELLS = 1 << 21  # (genome, route) pairs that a task holds
_NONE = np.zeros(0)


def _spread(n: float, mean: float, m2: float, x: np.ndarray) -> tuple[float, float, float]:
    """Count, mean and squared deviations with the values ``x`` added."""
    if not len(x):
        return n, mean, m2
    k, m = len(x), float(x.mean())
    d = m - mean
    return n + k, mean + d * k / (n + k), m2 + float(((x - m) ** 2).sum()) + d * d * n * k / (n + k)


class _Taken:
    """A batch of trades with what depends on no genome, and the part of it that a genome takes."""

    def __init__(self, pdf: pd.DataFrame):
        self.latency, self.qty, self.price, self.utility, self.expected = (
            pdf[c].to_numpy(float) for c in ("latency_ms", "qty", "buy_price", "utility", "expected"))
        self.partial = pdf["partial"].fillna(False).to_numpy(bool)
        self.net = self.expected / (self.price * self.qty) * 10000.0

    def of(self, g: Genome) -> tuple[np.ndarray, ...]:
        """Index, size, utility, expected value and capital of the trades that ``g`` takes, in order."""
        if g.max_btc <= 0:
            return np.zeros(0, int), _NONE, _NONE, _NONE, _NONE
        at = np.flatnonzero((self.net >= g.min_bps) & (self.latency <= g.max_latency_ms))
        size = np.minimum(self.qty[at], g.max_btc)
        scale = size / self.qty[at]
        return at, size, self.utility[at] * scale, self.expected[at] * scale, self.price[at] * size


def _window_fold(genomes: list[Genome]):
    """Task function: folds ordered trades into one row per genome, and one per genome and route."""

    def work(batches):
        from pyspark import TaskContext

        z = [dict.fromkeys(_WINDOW, 0.0) | {"hi": -np.inf, "lo": np.inf} for _ in genomes]
        routes: dict[str | None, np.ndarray] = {}
        for pdf in batches:
            t = _Taken(pdf)
            number, names = pd.factorize(pdf["route"], use_na_sentinel=False)
            wins, counts = np.zeros((len(names), len(genomes))), np.zeros((len(names), len(genomes)))
            for i, g in enumerate(genomes):
                at, size, u, e, capital = t.of(g)
                if not len(at):
                    continue
                f, win = z[i], u > 0
                f["won"] += float(win.sum())
                f["partials"] += float(t.partial[at].sum())
                f["latency"] += float(t.latency[at].sum())
                f["r_count"], f["r_mean"], f["r_m2"] = _spread(f["r_count"], f["r_mean"], f["r_m2"], (u / capital)[capital > 0])
                f["trades"], f["n_mean"], f["n_m2"] = _spread(f["trades"], f["n_mean"], f["n_m2"], e / np.maximum(capital, 1e-8) * 10000.0)
                f["largest"] = max(f["largest"], float(size.max()))
                path = f["s"] + np.cumsum(u)
                f["dd"] = max(f["dd"], float((np.maximum(np.maximum.accumulate(path), f["hi"]) - path).max()))
                f["hi"], f["lo"], f["s"] = max(f["hi"], float(path.max())), min(f["lo"], float(path.min())), float(path[-1])
                wins[:, i], counts[:, i] = np.bincount(number[at], win, len(names)), np.bincount(number[at], minlength=len(names))
            for k, name in enumerate(names):
                name = None if pd.isna(name) else name
                old = routes.get(name)
                routes[name] = np.stack([wins[k], counts[k]]) + (0 if old is None else old)
        part = TaskContext.get().partitionId()
        yield pd.DataFrame([{"genome": i, "part": part, "kind": 0} | f for i, f in enumerate(z) if f["trades"]] + [
            {"genome": i, "part": part, "kind": 1, "route": name, "won": w, "trades": n}
            for name, (ws, ns) in routes.items() for i, (w, n) in enumerate(zip(ws, ns)) if n],
            columns=["genome", "part", "kind", "route", *_WINDOW])

    return work


def _usable(ops: DataFrame, order: list[str]) -> DataFrame:
    """The trades a genome could take, written once."""
    usable = ops.where((F.col("buy_price") * F.col("qty") > 0) & (F.col("qty") > 0) & F.col("utility").isNotNull() & F.col("expected").isNotNull())
    kinds = {c: "double" for c in ("latency_ms", "qty", "buy_price", "utility", "expected")}
    return stage(usable.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in _TRADE), *[c for c in order if c not in _TRADE]))


def _blocks(rows: DataFrame, genomes: list[Genome]) -> list[list[Genome]]:
    """Genomes in blocks for which all routes fit into a task."""
    routes = max(1, rows.select("route").distinct().count())
    width = max(1, ROUTE_CELLS // routes)
    return [genomes[i:i + width] for i in range(0, len(genomes), width)]


def _named(genomes: list[Genome]) -> Column:
    return F.element_at(F.array(*[F.lit(g.name) for g in genomes]), F.col("genome") + 1)


class Population:
    """Genomes scored on the same trades. No row is made per trade and genome.

    The trades are written once and cut along the order. A task streams its part and keeps, per genome, sums, spreads and the
    drawdown of its part, and per (genome, route) wins and trades; only those rows are combined. What
    the score weights are worth needs means and route counts of all trades, so a second pass reads the
    trades again with them and gives one row per task and genome. Input: buy_price, qty, utility,
    expected, latency_ms, partial, route and the order; trades without utility or expected value are left out.
    """

    def __init__(self, ops: DataFrame, genomes: list[Genome], order: list[str], parts: int | None = None):
        self.trades = _usable(ops, order)
        # tasks follow each other along the order, which a table read again would not keep
        ordered = self.trades.repartitionByRange(parts or default_parts(ops.sparkSession), *order).sortWithinPartitions(*order)
        self.blocks = []
        schema = "genome int, part int, kind int, route string, " + ", ".join(f"{c} double" for c in _WINDOW)
        for block in _blocks(self.trades, genomes):
            self.blocks.append((block, stage(ordered.select(*_TRADE).mapInPandas(_window_fold(block), schema))))

    def windows(self) -> DataFrame:
        """Per genome: trades, P&L, mean, clamped Sharpe, win rate, drawdown, latency, partial rate, tolerance."""
        return self._union(self._windows)

    def calibration(self) -> DataFrame:
        """Per genome, how well the score predicts winners: 1 - squared error, and an edge weighted by outcome.

        A route's reliability leaves the scored trade out, so it is (wins - own) / (count - 1).
        """
        return self._union(self._calibration)

    def _union(self, make) -> DataFrame:
        out = None
        for block, folded in self.blocks:
            part = make(block, folded)
            out = part if out is None else out.unionByName(part)
        return out

    def _totals(self, folded: DataFrame) -> DataFrame:
        c = F.col
        f = folded.where("kind = 0")
        mean = lambda m, n: F.sum(c(m) * c(n)) / F.sum(n)
        whole = f.groupBy("genome").agg(mean("r_mean", "r_count").alias("_r"), mean("n_mean", "trades").alias("_n"))
        f = f.join(whole, "genome")
        m2 = lambda m, n, to: F.sum(c(f"{m}_m2") + c(n) * (c(f"{m}_mean") - c(to)) * (c(f"{m}_mean") - c(to)))
        return f.groupBy("genome").agg(
            *[F.sum(x).alias(x) for x in ("trades", "won", "partials", "latency", "r_count")], F.sum("s").alias("total"), F.first("_r").alias("r_mean"),
            m2("r", "r_count", "_r").alias("r_m2"), F.first("_n").alias("n_mean"), m2("n", "trades", "_n").alias("n_m2"), F.max("largest").alias("largest"))

    def _windows(self, block: list[Genome], folded: DataFrame) -> DataFrame:
        c = F.col
        sd = F.sqrt(c("r_m2") / (c("r_count") - 1))
        down = fold_drawdown(folded.where("kind = 0"), ["genome"], "part")
        out = self._totals(folded).join(down, "genome")
        return out.select(
            _named(block).alias("genome"), c("trades").cast("bigint").alias("trades"), (c("total") / c("trades")).alias("mean"),
            F.when((c("r_count") < 2) | (c("r_m2") == 0), 0.0).otherwise(clamp(c("r_mean") / sd, -5, 5)).alias("sharpe"), ratio("won", "trades").alias("win_rate"),
            (c("latency") / c("trades")).alias("mean_latency"), ratio("partials", "trades").alias("partial_rate"),
            F.element_at(F.array(*[F.lit(g.max_latency_ms) for g in block]), c("genome") + 1).alias("tolerance"), "pnl", "max_drawdown")

    def _calibration(self, block: list[Genome], folded: DataFrame) -> DataFrame:
        spreads = {r["genome"]: r for r in self._totals(folded).collect()}  # one row per genome
        counts: dict[str | None, np.ndarray] = {}
        for r in folded.where("kind = 1").groupBy("genome", "route").agg(F.sum("won").alias("won"), F.sum("trades").alias("n")).toLocalIterator():
            counts.setdefault(r["route"], np.zeros((2, len(block))))[:, r["genome"]] = r["won"], r["n"]  # ROUTE_CELLS at most
        known = []
        for i, g in enumerate(block):
            r = spreads.get(i)
            n = r["trades"] if r else 0
            sd = max((r["n_m2"] / (n - 1)) ** 0.5, 1e-8) if n > 1 else 1.0
            known.append((g, r["n_mean"] if r else 0.0, sd, max(r["largest"] if r else 0.0, 1e-8)))
        shared = self.trades.sparkSession.sparkContext.broadcast((known, counts))
        sums = self.trades.select(*_TRADE).mapInPandas(_calibration_fold(shared), "genome int, n double, fit double, edge double")
        c = F.col
        return sums.groupBy("genome").agg(F.sum("n").alias("n"), F.sum("fit").alias("fit"), F.sum("edge").alias("edge")).select(
            _named(block).alias("genome"), clamp(c("fit") / c("n"), 0, 1).alias("calibration"), clamp(0.5 + c("edge") / c("n"), 0, 1).alias("edge"))


def _calibration_fold(shared):
    """Task function: squared errors and weighted outcomes of the scores, one row per genome."""

    def work(batches):
        known, counts = shared.value
        z = np.zeros((len(known), 3))
        for pdf in batches:
            t = _Taken(pdf)
            number, names = pd.factorize(pdf["route"], use_na_sentinel=False)
            table = np.stack([counts[None if pd.isna(x) else x] if (None if pd.isna(x) else x) in counts else np.zeros((2, len(known))) for x in names]) if len(names) else None
            for i, (g, mean, sd, largest) in enumerate(known):
                at, size, u, e, capital = t.of(g)
                if not len(at):
                    continue
                hit = (u > 0).astype(float)
                won, n = table[number[at], 0, i], table[number[at], 1, i]
                reliable = np.where(n > 1, (won - hit) / np.maximum(n - 1, 1), 0.5)
                net = e / np.maximum(capital, 1e-8) * 10000.0
                raw = np.array(g.weights, float)
                w = np.maximum(raw, 0.0) / raw.sum() if raw.sum() > 0 else np.array(WEIGHTS)
                features = (e / 100.0, 1.0 - t.latency[at] / max(g.max_latency_ms, 1), size / largest, reliable, (net - mean) / sd / 3.0)
                p = np.clip(sum(x * np.clip(f, 0.0, 1.0) for x, f in zip(w, features)), 0.0, 1.0)
                z[i] += len(at), (1.0 - (p - hit) ** 2).sum(), ((p - 0.5) * np.tanh(u / 25.0)).sum()
        yield pd.DataFrame([(i, *row) for i, row in enumerate(z.tolist()) if row[0]], columns=["genome", "n", "fit", "edge"])

    return work


def fitness(w, failures: int = 0) -> Column:
    """Scalar fitness of a window row with calibration and edge."""
    c = F.col
    late = F.when(c("tolerance") >= c("mean_latency"), 0.0).otherwise((c("mean_latency") - c("tolerance")) / 500.0)
    fail = F.lit(float(failures)) / F.greatest(c("trades") + failures, F.lit(1))
    zero = F.lit(0.0)
    return (
        F.least(F.sqrt(F.greatest(c("mean"), zero)) * 6.0, F.lit(35.0)) + c("sharpe") * 8.0 + c("win_rate") * 22.0
        + F.least(F.sqrt(F.greatest(c("pnl"), zero)) * 0.8, F.lit(40.0)) + c("calibration") * 16.0 + c("edge") * 14.0
        - F.least(c("max_drawdown") / 250.0, F.lit(30.0)) - fail * 40.0 - F.least(late, F.lit(20.0)) - c("partial_rate") * 5.0)


def evaluate(ops: DataFrame, genomes: list[Genome], order: list[str], failures: int = 0, parts: int | None = None) -> DataFrame:
    """Window, weight calibration, fitness and the four maximised objectives per genome."""
    all_ = Population(ops, genomes, order, parts)
    out = all_.windows().join(all_.calibration(), "genome")
    out = out.withColumn("fitness", fitness(out, failures))
    c = F.col
    return out.withColumns({"o_pnl": c("pnl"), "o_sharpe": c("sharpe"), "o_drawdown": -c("max_drawdown"), "o_win_rate": c("win_rate")})


def rule_sensitivity(ops: DataFrame, order: list[str], base: Genome = Genome("configuracion_activa"), parts: int | None = None) -> DataFrame:
    """Four fixed rule sets on the same trades: quantiles, drawdown, trades, profit factor, win rate."""
    sets = [
        Genome("solo_spread", (0.0,) * 5, 5.0, base.max_btc, base.max_latency_ms), Genome("conservador", base.weights, 15.0, 0.05, base.max_latency_ms),
        Genome("ev_fijo", (1.0,) * 5, base.min_bps, base.max_btc, base.max_latency_ms), base]
    rows = selected(ops, sets)
    loss = F.sum(F.when(F.col("u") <= 0, -F.col("u")).otherwise(0.0))
    gain = F.sum(F.when(F.col("u") > 0, F.col("u")).otherwise(0.0))
    agg = rows.groupBy("genome").agg(
        F.count("*").alias("trades"), F.when(loss == 0, F.greatest(gain, F.lit(1.0))).otherwise(gain / loss).alias("profit_factor"),
        ratio(F.count_if(F.col("u") > 0), F.count("*")).alias("win_rate"))
    pct = rank_percentiles(rows, ["genome"], "u", {"median": 0.5, "p05": 0.05, "p95": 0.95}, parts=parts)
    return agg.join(pct, "genome").join(drawdown(rows, ["genome"], order, "u", parts), "genome")


def _skyline(x: np.ndarray) -> np.ndarray:
    """Mask of rows that no other row dominates."""
    order = np.lexsort(tuple(-x[:, i] for i in range(x.shape[1] - 1, -1, -1)))
    front: list[int] = []
    for i in order:
        f = x[front]
        if not len(front) or not ((f >= x[i]).all(axis=1) & (f > x[i]).any(axis=1)).any():
            front.append(i)
    mask = np.zeros(len(x), bool)
    mask[front] = True
    return mask


def _beaten(x: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Mask of rows of ``x`` that a rival dominates. ``rivals`` by falling sum: only those with a larger sum can."""
    out, sums = np.zeros(len(x), bool), x.sum(axis=1)
    falling = -rivals.sum(axis=1)
    for at in range(0, len(rivals), RIVALS):
        some = np.flatnonzero(~out & (sums <= -falling[at] + 1e-6 * max(1.0, abs(falling[at]))))
        if not len(some):
            break
        r = rivals[at:at + RIVALS]
        for part in np.array_split(some, -(-len(some) // RIVALS)):
            v = x[part][:, None, :]
            out[part] |= ((r >= v).all(axis=2) & (r > v).any(axis=2)).any(axis=1)
    return out


def frontier(df: DataFrame, objectives=OBJECTIVES, block: int = FRONTIER_BLOCK) -> DataFrame:
    """Rows not dominated in any of the maximised objectives.

    Every task keeps its own frontier. The distinct points that survive are then the rivals of all
    survivors: they go to the tasks in blocks of at most ``block`` points and every task drops its beaten
    rows, so rows are never compared as a full cross product and no task holds the whole frontier.
    """
    cols = list(objectives)

    def local(batches):
        kept = None
        for pdf in batches:
            both = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            kept = both[_skyline(both[cols].to_numpy(float))] if len(both) else both
        if kept is not None and len(kept):
            yield pd.DataFrame({c: kept[c].tolist() for c in kept.columns})

    def against(shared):
        def work(batches):
            for pdf in batches:
                good = pdf[~_beaten(pdf[cols].to_numpy(float), shared.value)] if len(pdf) else pdf
                yield pd.DataFrame({c: good[c].tolist() for c in good.columns})

        return work

    kept = stage(df.mapInPandas(local, df.schema))
    points = kept.select(*[F.col(c).cast("double").alias(c) for c in cols]).distinct()
    blocks = -(-points.count() // block)
    if blocks > 1:
        points = stage(points.withColumn("_block", F.pmod(F.xxhash64(*cols), F.lit(2 * blocks))))
    out = kept
    for i in range(2 * blocks if blocks > 1 else blocks):  # the hash fills blocks unevenly, so they are made half as large
        some = points.where(F.col("_block") == i).drop("_block") if blocks > 1 else points
        rivals = np.array([tuple(r) for r in some.toLocalIterator()], float).reshape(-1, len(cols))
        shared = df.sparkSession.sparkContext.broadcast(rivals[np.argsort(-rivals.sum(axis=1), kind="stable")])
        out = out.mapInPandas(against(shared), df.schema)
    return out


def pareto_ranks(df: DataFrame, key: str, objectives=OBJECTIVES, max_fronts: int | None = None) -> DataFrame:
    """Add ``front`` (0 = frontier). Each round peels one frontier; rounds are staged."""
    rest, k, out = stage(df), 0, None
    while max_fronts is None or k < max_fronts:
        front = stage(frontier(rest, objectives).withColumn("front", F.lit(k)))
        if front.isEmpty():
            break
        out = front if out is None else out.unionByName(front)
        rest = stage(rest.join(front.select(key), key, "left_anti"))
        k += 1
    return out if out is not None else df.withColumn("front", F.lit(0)).limit(0)


def crowding(df: DataFrame, key: str, objectives=OBJECTIVES, parts: int | None = None) -> DataFrame:
    """Crowding distance per front; the extreme rows of every objective get infinity.

    Neighbours are sought among the distinct values of a front, cut into buckets along the objective: the value
    before is the largest so far. Rows of one value lie side by side in the order of ``key``, so only the
    first and last of them look beyond it. So a front with all rows, or a value with many, is many tasks' work.
    """
    out = stage(df).withColumn("crowding", F.lit(0.0))
    for o in objectives:
        values = stage(out.groupBy("front", o).agg(F.min(key).alias("_first"), F.max(key).alias("_last")).withColumns({"_up": F.col(o), "_down": -F.col(o)}))
        below = running(values, ["front"], ["_up"], {"_below": ("max", "_up")}, parts, exclusive=True)
        both = running(below, ["front"], ["_down"], {"_above": ("max", "_down")}, parts, exclusive=True)
        span = values.groupBy("front").agg((F.max(o) - F.min(o)).alias("_span"))
        rows = _same(_same(out, both.drop("_up", "_down"), ["front", o]), span, ["front"])
        low = F.when(F.col(key) == F.col("_first"), F.col("_below")).otherwise(F.col(o))
        high = F.when(F.col(key) == F.col("_last"), -F.col("_above")).otherwise(F.col(o))
        gap = F.coalesce((high - low) / F.greatest("_span", F.lit(1e-9)), F.lit(float("inf")))
        out = rows.withColumn("crowding", F.col("crowding") + gap).select(*df.columns, "crowding")
    return out


def diversity(df: DataFrame, weights: str = "weights") -> DataFrame:
    """Pooled spread of the weights of a population, scaled to [0, 1]."""
    w = df.select(F.posexplode(weights).alias("i", "w")).groupBy("i").agg(F.var_pop("w").alias("v"), F.count("*").alias("n"))
    return w.agg(F.when(F.max("n") < 2, 0.0).otherwise(clamp(F.sqrt(F.avg("v")) * 5.0, 0, 1)).alias("diversity"))


def run_comparison(runs: DataFrame, keys: list[str], pnl: str = "pnl") -> DataFrame:
    """Compare configurations over their runs: profit factor, win rate, worst loss, quantiles.

    Order statistics use the index floor(n q) here.
    """
    p = F.col(pnl)
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p <= 0, -p).otherwise(0.0))
    agg = runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), (gain / F.greatest(loss, F.lit(1.0))).alias("profit_factor"),
        ratio(F.count_if(p > 0), F.count("*")).alias("win_rate"), F.abs(F.least(F.min(p), F.lit(0.0))).alias("worst_loss"))
    pct = rank_percentiles(runs, keys, pnl, {"median": 0.5, "p05": 0.05, "p95": 0.95}, rule="floor")
    return _same(agg, pct, keys)
