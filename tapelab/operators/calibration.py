"""Probability calibration: metrics, Platt scaling, isotonic steps."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.functions.numeric import Z_CALIBRATION, clamp, col, logit, ratio, sigmoid, wilson
from tapelab.operators.ordered import Cuts, bucket_of

BINS = 10
LOGIT_STEP = 0.001  # at most 27 632 cells between the clipped logits


def score_metrics(p: str, y: str) -> dict[str, Column]:
    """Brier score and log-loss (clipped at 1e-9) as aggregates."""
    q = clamp(p, 1e-9, 1.0 - 1e-9)
    hit = F.col(y).cast("double")
    return {
        "observations": F.count("*"),
        "brier": F.avg((F.col(p) - hit) * (F.col(p) - hit)),
        "log_loss": -F.avg(F.when(F.col(y).cast("boolean"), F.ln(q)).otherwise(F.ln(1.0 - q))),
    }


def reliability(df: DataFrame, p: str, y: str) -> DataFrame:
    """Ten bins with predicted mean, observed rate and Wilson bounds; empty bins are kept."""
    b = F.least(F.floor(F.col(p) * BINS), F.lit(BINS - 1)).cast("int")
    hits = df.groupBy(b.alias("bin")).agg(F.count("*").alias("_n"), F.sum(p).alias("_p"), F.count_if(F.col(y).cast("boolean")).alias("_k"))
    bins = df.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(F.broadcast(hits), "bin", "left").select(  # ten rows at most
        "bin", F.coalesce("_n", F.lit(0)).alias("observations"), F.coalesce("_p", F.lit(0.0)).alias("_p"), F.coalesce("_k", F.lit(0)).alias("hits"))
    w = wilson("hits", "observations", Z_CALIBRATION)
    return out.select(
        "bin", "observations", ratio("_p", "observations").alias("predicted"), ratio("hits", "observations").alias("observed"),
        w["lower"].alias("lower"), w["upper"].alias("upper"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error from the reliability table."""
    n = F.sum("observations").cast("double")
    return bins.agg((F.sum(F.col("observations") * F.abs(F.col("predicted") - F.col("observed"))) / F.greatest(n, F.lit(1.0))).alias("ece"))


def fit_platt(df: DataFrame, p: str, y: str, steps: int = 800, rate: float = 0.08, cell: float = LOGIT_STEP) -> tuple[float, float]:
    """Slope and offset after ``steps`` gradient steps from (1, 0).

    The rows are first counted per logit cell of width ``cell`` (a fixed number of cells, each with
    its mean logit), so a step costs the same for any number of rows. Within a cell the logistic
    curve is taken as straight: it bends by at most 0.1, so a step's sums are off by less than
    0.1 * cell**2 / 8 per row (about 1e-8 at the default).
    """
    x = logit(p)
    cells = df.groupBy(F.round(x / cell).cast("int").alias("cell")).agg(
        F.avg(x).alias("x"), F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("k"))
    t = cells.orderBy("cell").toPandas()
    xs, n, k = t["x"].to_numpy(), t["n"].to_numpy(float), t["k"].to_numpy(float)
    a, b, scale = 1.0, 0.0, rate / max(n.sum(), 1.0)
    for _ in range(steps):
        err = n / (1.0 + np.exp(-np.clip(a * xs + b, -30.0, 30.0))) - k
        a, b = a - scale * float(err @ xs), b - scale * float(err.sum())
    return a, b


def platt(p, fit: tuple[float, float]) -> Column:
    return sigmoid(fit[0] * logit(p) + fit[1])


def fit_isotonic(df: DataFrame, p: str, y: str) -> list[tuple[float, float]]:
    """Non-decreasing steps (upper end, value). Equal probabilities are averaged before the fit.

    Spark pools violators within range-partitioned tasks; only the blocks left come to the driver.
    """
    pts = df.groupBy(F.col(p).alias("x")).agg(F.avg(F.col(y).cast("double")).alias("label"), F.count("*").cast("double").alias("w"))
    pts = VectorAssembler(inputCols=["x"], outputCol="features").transform(pts)
    model = IsotonicRegression(weightCol="w").fit(pts)
    steps: dict[float, float] = {}
    for x, v in zip(model.boundaries.toArray(), model.predictions.toArray()):
        if steps and list(steps.values())[-1] == v:
            steps.pop(next(reversed(steps)))
        steps[float(x)] = float(v)
    return list(steps.items())


def isotonic(p, steps: list[tuple[float, float]]) -> Column:
    """Value of the first step whose end is at or above p, else of the last one."""
    ends = [s[0] for s in steps]
    values = F.split(F.lit(",".join(repr(s[1]) for s in steps)), ",").cast("array<double>")
    if len(ends) == 1:
        return F.get(values, F.lit(0)) + col(p) * 0.0
    # number of ends strictly below p: search for the negated values from the other side
    cuts = Cuts(tuple(-e for e in reversed(ends)), (None,) * len(ends))
    at_or_above = bucket_of(cuts, [-col(p)])
    i = F.lit(len(ends)) - at_or_above
    return F.get(values, F.least(i, F.lit(len(ends) - 1)))
