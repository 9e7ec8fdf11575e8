"""Paired resampling tests on two per-tick result series.

Input ``series``: tick (0..n-1), base, cand, base_fills, cand_fills, routes.
Draws come from a hash of (seed, resample, position), so they do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab.functions.numeric import clamp
from tapelab.operators.ordered import rank_percentiles, rolling_rows
from tapelab.session import small, stage

# Block lengths and number of resamples.
BLOCKS = (30, 60, 120)
RESAMPLES = 10_000


def draw(seed: int, *parts) -> Column:
    """A non-negative 60-bit number from the MD5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _path(values) -> Column:
    """Fold an array of results to struct(s, hi, lo, dd) of its running sum."""
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    start = F.struct(zero.alias("s"), none.alias("hi"), none.alias("lo"), zero.alias("dd"))

    def step(a, x):
        p = a["s"] + x
        hi = F.greatest(a["hi"], p)
        return F.struct(p.alias("s"), hi.alias("hi"), F.least(a["lo"], p).alias("lo"), F.greatest(a["dd"], hi - p).alias("dd"))

    return F.aggregate(values, start, step)


def block_table(series: DataFrame, lengths: list[int]) -> DataFrame:
    """Summary of the block of every start and length: paths of both series, fills and routes."""
    b = max(lengths)
    names = ["base", "cand", "base_fills", "cand_fills", "routes"]
    rows = series.withColumns({"rank": F.col("tick"), "base": F.col("base").cast("double"), "cand": F.col("cand").cast("double")})
    aggs = {f"_{n}": (lambda w, n=n: F.collect_list(n).over(w.rowsBetween(0, b - 1))) for n in names}
    rows = rolling_rows(rows.withColumn("n", F.lit(0)), [], ["rank"], aggs, ahead=b - 1, ready=True)
    rows = rows.withColumn("len", F.explode(F.array(*[F.lit(x) for x in lengths]))).where(F.size("_base") >= F.col("len"))
    cut = lambda n: F.slice(f"_{n}", F.lit(1), F.col("len"))
    total = lambda n: F.aggregate(cut(n), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        F.col("tick").alias("start"), "len", _path(cut("base")).alias("b"), _path(cut("cand")).alias("c"),
        total("base_fills").alias("base_fills"), total("cand_fills").alias("cand_fills"), total("routes").alias("routes"))


def resamples(series: DataFrame, n: int, block: int, count: int = RESAMPLES, seed: int = 1) -> DataFrame:
    """Metrics of every resample: P&L, fill rate and drawdown of both series.

    A resample is ceil(n / block) drawn blocks, the last one cut to fill n ticks. Blocks are
    summarised once; a resample only folds its summaries, so no tick is copied.
    """
    block = max(1, min(block, n))
    full, rest = divmod(n, block)
    k = full + (1 if rest else 0)
    blocks = block_table(series, sorted({block, rest} - {0}))
    d = series.sparkSession.range(count).withColumnRenamed("id", "r").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    d = d.withColumn("start", draw(seed, "r", "j") % (n - block + 1))
    d = d.withColumn("len", F.when((F.col("j") == full), F.lit(rest)).otherwise(F.lit(block)))
    d = d.join(small(stage(blocks)), ["start", "len"])
    # each resample has its k summaries in one row: both paths are folded there, after one shuffle
    drawn = d.groupBy("r").agg(
        F.sort_array(F.collect_list(F.struct("j", "b", "c"))).alias("p"),
        *[F.when(F.sum("routes") == 0, 0.0).otherwise(F.sum(f) / F.sum("routes")).alias(f"{s}_fill") for s, f in (("b", "base_fills"), ("c", "cand_fills"))])
    out = drawn.select("r", _joined("b").alias("_b"), _joined("c").alias("_c"), "b_fill", "c_fill").select(
        "r", *[F.col(f"_{s}.{v}").alias(f"{s}_{n}") for s in "bc" for v, n in (("s", "pnl"), ("dd", "drawdown"))], "b_fill", "c_fill")
    return out.withColumns({f"d_{m}": F.col(f"c_{m}") - F.col(f"b_{m}") for m in ("pnl", "fill", "drawdown")})


def _joined(side: str) -> Column:
    """Final sum and largest drawdown (below the highest sum so far, or zero) of the paths of a resample in their order."""
    zero = F.lit(0.0)

    def step(a, x):
        x = x[side]
        return F.struct((a["s"] + x["s"]).alias("s"), F.greatest(a["hi"], a["s"] + x["hi"]).alias("hi"),
                        F.greatest(a["dd"], x["dd"], a["hi"] - a["s"] - x["lo"]).alias("dd"))

    return F.aggregate("p", F.struct(zero.alias("s"), zero.alias("hi"), zero.alias("dd")), step)


METRICS = [f"{s}_{m}" for s in "bcd" for m in ("pnl", "fill", "drawdown")]


def all_lengths(series: DataFrame, n: int, seed: int = 1, count: int = RESAMPLES) -> DataFrame:
    """Resamples of every block length, with their ``block``; each length has a seed of its own."""
    out = None
    for i, block in enumerate(BLOCKS):
        rows = resamples(series, n, block, count, seed + i).withColumn("block", F.lit(block))
        out = rows if out is None else out.unionByName(rows)
    return out


def bootstrap(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Median and 95 % percentile interval of every metric (rows by, metric, median, lower, upper)."""
    by = by or []
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])))
    return rank_percentiles(long, [*by, "metric"], "v", {"median": 0.5, "lower": 0.025, "upper": 0.975})


def verdict(rows: DataFrame, intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    p = rows.groupBy(*by).agg((F.count_if(F.col("d_pnl") > 0) / F.count("*")).alias("p_better"))
    d = intervals.where("metric = 'd_pnl'")
    d = d.join(p, by) if by else d.join(F.broadcast(p))
    text = (
        F.when((F.col("lower") <= 0) & (F.col("upper") >= 0), "resultado inconcluso")
        .when(F.col("lower") > 0, "candidato superior").otherwise("baseline superior"))
    return d.select(*by, "p_better", text.alias("result"))


def block_sums(series: DataFrame, block: int) -> DataFrame:
    return series.groupBy(F.floor(F.col("tick") / block).alias("block")).agg(F.sum(F.col("cand") - F.col("base")).alias("delta"))


def effect_size(sums: DataFrame) -> DataFrame:
    """Cohen's dz: mean block difference over its standard deviation."""
    n = F.count("*")
    return sums.agg(n.alias("blocks"), F.when(n > 1, F.avg("delta") / F.greatest(F.stddev_samp("delta"), F.lit(1e-12))).otherwise(0.0).alias("dz"))


def permutation_test(sums: DataFrame, count: int = RESAMPLES, seed: int = 1) -> DataFrame:
    """Sign-flip test on block sums, two-sided p = (k + 1) / (R + 1).

    Each block sum carries its own ``count`` signs; they are added up per resample with partial
    sums before the shuffle.
    """
    flips = sums.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    signed = F.when(draw(seed, "r", "block") % 2 == 0, F.col("delta")).otherwise(-F.col("delta"))
    totals = flips.groupBy("r").agg(F.sum(signed).alias("s"))
    seen = sums.agg(F.sum("delta").alias("observed"))
    hit = totals.join(F.broadcast(seen)).agg(F.max("observed").alias("observed"), F.count_if(F.abs("s") >= F.abs("observed")).alias("extreme"))
    return hit.select("observed", ((F.col("extreme") + 1.0) / (count + 1.0)).alias("p_value"))


def holm(df: DataFrame, p: str = "p_value", name: str = "name") -> DataFrame:
    """Holm adjustment of a table of p-values (one row per compared model)."""
    w = W.orderBy(p, name)
    rank = F.row_number().over(w)
    m = F.count("*").over(W.partitionBy(F.lit(1)))
    step = (m - rank + 1) * clamp(p, 0, 1)
    return df.withColumn("_s", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_s")


def five_windows(series: DataFrame, n: int) -> DataFrame:
    """Difference of the results in five equal windows; positive ones favour the candidate."""
    bounds = [i * n // 5 for i in range(6)]
    idx = F.lit(0)
    for b in bounds[1:5]:
        idx = idx + F.when(F.col("tick") >= b, 1).otherwise(0)
    return series.groupBy(idx.alias("window")).agg(F.sum(F.col("cand") - F.col("base")).alias("delta")).withColumn("favourable", F.col("delta") > 0)


def paired_series(base: DataFrame, cand: DataFrame, key: list[str]) -> DataFrame:
    """Equi-join of two per-tick tables (pnl, fills, routes) on their tick key."""
    b = base.select(*key, F.col("pnl").alias("base"), F.col("fills").alias("base_fills"), "routes")
    c = cand.select(*key, F.col("pnl").alias("cand"), F.col("fills").alias("cand_fills"))
    return b.join(c, key)


