"""Microstructure study: features, markouts, fill labels and their calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.functions.scoring import features, fill_label, fill_probability, second_leg_risk
from tapelab.operators import calibration as K
from tapelab.operators.asof import asynchrony, latest_by_venue, venue_names
from tapelab.operators.backtest import split
from tapelab.operators.markouts import HORIZONS, event_markouts
from tapelab.operators.ordered import _same, range_cuts, rank_percentiles
from tapelab.session import stage

ORDER = ["t", "seq"]


def samples(quotes: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per usable book: features, asynchrony, markouts and the fill label."""
    # one set of cut points, from the plain quotes, serves both ordered steps
    cuts = range_cuts(quotes, ORDER, parts)
    df = features(quotes).drop("bids", "asks")
    df = latest_by_venue(df, [], by=[], venues=venue_names(quotes), cuts=cuts).withColumn("async_ms", asynchrony() / 1000.0).drop("latest")
    df = event_markouts(df, ["venue", "pair"], ORDER, cuts=cuts)
    df = df.withColumn("filled", fill_label("markout_e1", "bid", "ask"))
    return df.withColumns({"raw": fill_probability(), "leg_risk": second_leg_risk()})


def venue_summary(df: DataFrame) -> DataFrame:
    base = df.groupBy("venue").agg(
        F.count("*").alias("observations"), F.avg("skew_bps").alias("mean_skew_bps"),
        F.avg("imbalance_l5").alias("mean_imbalance"), F.avg(F.col("filled").cast("double")).alias("fill_rate"))
    age = rank_percentiles(df, ["venue"], "age_ms", {"age_p50": 0.5, "age_p95": 0.95})
    asyn = rank_percentiles(df, ["venue"], "async_ms", {"async_p95": 0.95})
    return _same(_same(base, age, ["venue"]), asyn, ["venue"])


def markout_means(df: DataFrame) -> DataFrame:
    return df.agg(
        *[F.coalesce(F.avg(f"markout_e{h}"), F.lit(0.0)).alias(f"markout_e{h}") for h in HORIZONS],
        F.coalesce(F.avg("leg_risk"), F.lit(0.0)).alias("mean_leg_risk"))


def calibrate(df: DataFrame):
    """Fit both calibrators on part B; returns (platt, steps)."""
    b = df.where("part = 'B'").select("raw", "filled")
    return K.fit_platt(b, "raw", "filled"), K.fit_isotonic(b, "raw", "filled")


def calibrated_holdout(df: DataFrame, fit, steps) -> DataFrame:
    c = df.where("part = 'C'")
    return c.withColumns({"platt": K.platt("raw", fit), "isotonic": K.isotonic("raw", steps)})


def model_metrics(c: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Brier score and log-loss of the raw and calibrated probabilities (per key)."""
    long = c.select(*(keys or []), "filled", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("raw", "platt", "isotonic")])))
    return long.groupBy(*(keys or []), "model").agg(*[v.alias(k) for k, v in K.score_metrics("p", "filled").items()])


def study(quotes: DataFrame, train: int = 50, calibrate_pct: int = 20) -> dict[str, DataFrame]:
    """Whole study: venues, markouts, model metrics, reliability, venue transfer, winner."""
    df = stage(split(stage(samples(quotes)), ORDER, train, calibrate_pct))
    c = stage(calibrated_holdout(df, *calibrate(df)))
    m = model_metrics(c)
    return {
        "venues": venue_summary(df), "markouts": markout_means(c), "metrics": m,
        "reliability": K.reliability(c.withColumn("p", F.col("platt")), "p", "filled"),
        "transfer": model_metrics(c, ["venue"]).where("model <> 'raw'"), "winner": m.orderBy("brier", "model").limit(1),
    }
