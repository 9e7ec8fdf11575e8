"""Ordered operators without a single-task sort.

Every operator here follows one pattern. Rows are cut into buckets of about equal size along the
order, using approximate quantiles of the order column (and of the tie column inside an instant
that alone fills several buckets). A bucket is summarised, the small summary table is folded over
the buckets, and the fold is joined back to the rows. So a key that holds a third of all rows is
spread over many tasks, and the result does not depend on where the cuts fall.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab.session import default_parts, small, stage

BUCKET = "_bucket"
FIRST = W.unboundedPreceding
WHOLE = 100_000  # rows of a key that one task may rank


@dataclass(frozen=True)
class Cuts:
    """Sorted cut points: ``at`` on the order column, ``tie`` on the tie column (or None)."""

    at: tuple
    tie: tuple


def range_cuts(df: DataFrame, order: list[str], parts: int | None = None) -> Cuts:
    """At most ``parts - 1`` cut points. Reads one column (two for a hot instant)."""
    parts = parts or default_parts(df.sparkSession)
    if parts < 2:
        return Cuts((), ())
    probs = [i / parts for i in range(1, parts)]
    accuracy = max(1000, 10 * parts)
    found = df.agg(F.percentile_approx(order[0], probs, accuracy).alias("q")).first()["q"] or []
    seen = Counter(found)
    hot = [v for v, k in seen.items() if k > 1]
    ties: dict = {}
    if hot and len(order) > 1:
        share = [i / parts for i in range(1, parts)]
        rows = (
            df.where(F.col(order[0]).isin(hot))
            .groupBy(F.col(order[0]).alias("v"))
            .agg(F.percentile_approx(order[1], share, accuracy).alias("q"))
            .collect()
        )
        for r in rows:
            k = seen[r["v"]]
            ties[r["v"]] = sorted({r["q"][int(i * len(r["q"]) / k)] for i in range(k)})
    pairs = sorted({(v, t) for v in seen for t in ties.get(v, [None])}, key=lambda p: (p[0], p[1] is not None, p[1] or 0))
    return Cuts(tuple(p[0] for p in pairs), tuple(p[1] for p in pairs))


def bucket_of(cuts: Cuts, order: list) -> Column:
    """Number of cuts at or before the row: a binary search over the literal cut array."""
    n = len(cuts.at)
    if n == 0:
        return F.lit(0)
    kind = "double" if isinstance(cuts.at[0], float) else "bigint"
    at = F.split(F.lit(",".join(map(repr, cuts.at))), ",").cast(f"array<{kind}>")
    key = (order[0] if isinstance(order[0], Column) else F.col(order[0])).cast(kind)
    tied = any(t is not None for t in cuts.tie)
    if tied:
        low = -(2**63)
        tie = F.split(F.lit(",".join(str(low if t is None else t) for t in cuts.tie)), ",").cast("array<bigint>")
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]

    def probe(acc, step):
        i = acc + step - 1
        c = F.get(at, i)
        hit = c <= key
        if tied:
            hit = (c < key) | ((c == key) & (F.get(tie, i) <= F.col(order[1]).cast("bigint")))
        return F.when(hit, acc + step).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe)


def bucketed(df: DataFrame, order: list[str], parts: int | None = None, cuts: Cuts | None = None) -> DataFrame:
    cuts = cuts if cuts is not None else range_cuts(df, order, parts)
    return df.withColumn(BUCKET, bucket_of(cuts, order))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may hold NULL; both sides are hashed on the keys."""
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(b, cond, how).drop(*[f"_r_{k}" for k in keys])


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame, keys: list[str], order: list[str], folds: dict[str, tuple[str, str]],
    parts: int | None = None, exclusive: bool = False, cuts: Cuts | None = None, totals: dict[str, str] | None = None,
) -> DataFrame:
    """Running aggregates along ``order`` inside every key: {new column: (kind, column)}.

    Kinds: sum, max, min. ``exclusive`` leaves the current row out (NULL on the first row).
    ``totals`` adds sums over the whole key: {new column: column}. ``cuts`` reuses known cut
    points; any cuts give the same result.

    What lies before a bucket enters it as one extra first row, so the rows are shuffled once, on
    (key, bucket), and never joined.
    """
    totals = totals or {}
    rows = bucketed(df, order, parts, cuts)
    group = keys + [BUCKET]
    before = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(FIRST, -1)
    whole = W.partitionBy(*keys)
    base = rows.groupBy(*group).agg(
        *[_FOLDS[k](c).alias(f"_f_{o}") for o, (k, c) in folds.items()], *[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()])
    head = base.select(
        *group, *[_FOLDS[k](f"_f_{o}").over(before).alias(f"_f_{o}") for o, (k, c) in folds.items()],
        *[F.sum(f"_t_{o}").over(whole).alias(f"_t_{o}") for o in totals], F.lit(0).alias("_row"))
    body = rows.select("*", *[F.col(c).alias(f"_f_{o}") for o, (k, c) in folds.items()], F.lit(1).alias("_row"))
    both = body.unionByName(head, allowMissingColumns=True)
    inside = W.partitionBy(*group).orderBy("_row", *order).rowsBetween(FIRST, -1 if exclusive else 0)
    here = W.partitionBy(*group)
    out = both.select(
        *[c for c in df.columns if c not in folds and c not in totals], "_row",
        *[_FOLDS[k](f"_f_{o}").over(inside).alias(o) for o, (k, c) in folds.items()],
        *[F.max(f"_t_{o}").over(here).alias(o) for o in totals])
    return out.where("_row = 1").drop("_row")


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], parts: int | None = None
) -> DataFrame:
    """Inclusive running sums along ``order`` inside every key: {new column: summed column}."""
    return running(df, keys, order, {o: ("sum", c) for o, c in sums.items()}, parts)


def ranked(
    df: DataFrame, keys: list[str], order: list[str], parts: int | None = None, cuts: Cuts | None = None, largest: int | None = None
) -> DataFrame:
    """Exact 0-based rank ``rank`` and group size ``n`` along ``order`` inside every key.

    ``largest`` is the number of rows of the largest key, if it is known: where that fits one task,
    a key needs no buckets.
    """
    if largest is not None and largest <= WHOLE:
        own = W.partitionBy(*keys)
        return df.drop("rank", "n").select(
            "*", (F.row_number().over(own.orderBy(*order)) - 1).cast("bigint").alias("rank"), F.count(F.lit(1)).over(own).alias("n"))
    one = df.drop("rank", "n").withColumn("_one", F.lit(1).cast("bigint"))
    out = running(one, keys, order, {"rank": ("sum", "_one")}, parts, cuts=cuts, totals={"n": "_one"})
    return out.withColumn("rank", F.col("rank") - 1).drop("_one")


def rolling_rows(
    df: DataFrame, keys: list[str], order: list[str], aggs: dict, back: int = 0, ahead: int = 0,
    chunk: int = 100_000, parts: int | None = None, ready: bool = False,
) -> DataFrame:
    """Row-frame windows over long keys.

    ``aggs`` maps a new column to a function Window -> Column. Each chunk of ``chunk`` consecutive
    rows is one window partition; its last ``back`` (first ``ahead``) rows are copied into the
    neighbour, so every frame that reaches at most that far sees the same rows as one big window.
    ``ready`` says that ``rank`` and ``n`` are already there.
    """
    rows = _chunks(df if ready else ranked(df, keys, order, parts), back, ahead, max(chunk, back, ahead, 1))
    w = W.partitionBy(*keys, "_chunk").orderBy("rank")
    for name, build in aggs.items():
        rows = rows.withColumn(name, build(w))
    return rows.where(~F.col("_halo")).drop("_chunk", "_halo")


def _chunks(rows: DataFrame, back: int, ahead: int, chunk: int) -> DataFrame:
    """Ranked rows with their ``_chunk``, and copies (``_halo``) of those that a neighbour's frames reach."""
    own = F.floor(F.col("rank") / chunk)
    off = F.col("rank") - own * chunk
    homes = [F.struct(own.alias("c"), F.lit(False).alias("h"))]
    if back:
        homes.append(F.when(off >= chunk - back, F.struct((own + 1).alias("c"), F.lit(True).alias("h"))))
    if ahead:
        homes.append(F.when((off < ahead) & (own > 0), F.struct((own - 1).alias("c"), F.lit(True).alias("h"))))
    rows = rows.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
    return rows.withColumn("_chunk", F.col("_home.c")).withColumn("_halo", F.col("_home.h")).drop("_home")


def rolling_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], back: int, chunk: int = 100_000, parts: int | None = None
) -> DataFrame:
    """Sums of whole numbers over the ``back`` rows before every row: {new column: summed column}; nulls count as 0.

    Rows are cut into cells of ``back`` rows. A frame is the end of the previous cell and the beginning
    of its own, both from one running sum a cell, so the work does not grow with ``back``.

    The rows are shuffled once, and ``sums`` are computed behind that: a key of more than ``chunk`` rows is
    cut along the order, by counts of rows between cut points, and what the first frames of a piece
    reach is copied into it.
    """
    c, size = F.col, max(chunk, back)
    rows = df.drop("rank", "n", *sums)
    columns = rows.columns
    large = stage(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size))
    group, own = keys, F.lit(1)
    if not large.isEmpty():
        rows, heads = _pieces(rows, keys, order, large, back, size, parts)
        group, own = [*keys, "_chunk"], F.when(~c("_halo"), 1)
    line = W.partitionBy(*group).orderBy(*order).rowsBetween(FIRST, 0)
    rows = rows.select("*", F.row_number().over(W.partitionBy(*group).orderBy(*order)).alias("_i"), F.sum(own).over(line).alias("rank"), F.count(F.lit(1)).over(W.partitionBy(*group)).alias("n"))
    if group != keys:
        rows = _same(rows, small(heads), group, "left")
        rows = rows.withColumns({"rank": c("rank") + F.coalesce("_o", F.lit(0)), "n": F.coalesce("_n", "n")}).drop("_o", "_n")
    rows = rows.withColumns({"_cell": F.floor((c("_i") - 1) / back), **{f"_v_{n}": F.coalesce(v, F.lit(0)).cast("bigint") for n, v in sums.items()}})
    cell = W.partitionBy(*group, "_cell").orderBy("_i")
    place = W.partitionBy(*group).orderBy("_cell", "_i")
    here = [F.sum(f"_v_{n}").over(cell.rowsBetween(FIRST, 0)).alias(f"_p_{n}") for n in sums]
    whole = [F.sum(f"_v_{n}").over(cell.rowsBetween(FIRST, W.unboundedFollowing)).alias(f"_w_{n}") for n in sums]
    rows = rows.select("*", *here, *whole)
    # the end of the previous cell starts ``back`` rows ago
    rows = rows.select("*", *[F.lag(c(f"_w_{n}") - c(f"_p_{n}") + c(f"_v_{n}"), back, 0).over(place).alias(f"_l_{n}") for n in sums])
    rows = rows if group == keys else rows.where(~c("_halo"))
    return rows.select(*columns, (c("rank") - 1).cast("bigint").alias("rank"), c("n").cast("bigint").alias("n"), *[(c(f"_l_{n}") + c(f"_p_{n}") - c(f"_v_{n}")).alias(n) for n in sums])


def _pieces(rows: DataFrame, keys: list[str], order: list[str], large: DataFrame, back: int, size: int, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``_chunk``, and copies (``_halo``) of those that frames of ``back`` rows may reach; and of every piece of a key in ``large`` the rows before it and in the key.

    Only the keys' rows between two cut points are counted, so no row needs its rank beforehand. A copy
    may hold more rows than the frames reach, never fewer.
    """
    c = F.col
    rows = bucketed(rows, order, 8 * (parts or default_parts(rows.sparkSession)))
    spans = _same(rows.select(*keys, BUCKET), small(large), keys).groupBy(*keys, BUCKET).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    spans = spans.withColumn("_b", F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(FIRST, -1)), F.lit(0)))
    spans = spans.withColumn("_own", F.floor(c("_b") / size))
    # a piece that starts fewer than ``back`` rows behind a span has one of two numbers
    reached = [F.floor((c("_b") + c("_c") + far) / size) for far in (0, back - 1)]
    homes = F.array_distinct(F.array_compact(F.array("_own", *[F.when(x > c("_own"), x) for x in reached])))
    first = F.min("_b").over(W.partitionBy(*keys, "_own"))
    spans = stage(spans.select(*keys, BUCKET, "_own", first.alias("_o"), "_n", homes.alias("_homes")))
    rows = _same(rows, small(spans.drop("_o", "_n")), [*keys, BUCKET], "left")
    rows = rows.withColumn("_chunk", F.explode(F.coalesce("_homes", F.array(F.lit(0).cast("bigint")))))
    rows = rows.withColumn("_halo", c("_chunk") != F.coalesce("_own", F.lit(0))).drop("_homes", "_own", BUCKET)
    return rows, spans.select(*keys, c("_own").alias("_chunk"), "_o", "_n").distinct()


def rolling_time(
    df: DataFrame, keys: list[str], t: str, width: int, pre: dict, over: dict[str, tuple[str, str]]
) -> DataFrame:
    """Windows over the last ``width`` time units, one output row per (key, instant).

    ``pre`` folds the rows of one instant ({column: aggregate}); this bounds a cell to ``width``
    instants whatever the load. ``over`` folds pre-folded columns: {new column: (kind, column)}, kinds
    sum, max, min. Cells are ``width`` wide and see the previous cell too, so no frame is cut.

    A frame is an end of the previous cell and a beginning of its own. Both are running folds, one
    from late to early, one from early to late, so the work does not grow with the rows in a frame.
    """
    inst = df.groupBy(*keys, t).agg(*[a.alias(n) for n, a in pre.items()])
    own = F.floor(F.col(t) / width)
    inst = inst.withColumn(
        "_home",
        F.explode(F.array(F.struct(own.alias("c"), F.lit(False).alias("h")), F.struct((own + 1).alias("c"), F.lit(True).alias("h")))),
    )
    inst = inst.withColumn("_cell", F.col("_home.c")).withColumn("_halo", F.col("_home.h")).drop("_home")
    # an instant of the previous cell is seen up to t + width, that time included
    inst = inst.withColumn("_seen", F.when(F.col("_halo"), F.col(t) + width).otherwise(F.col(t)))
    cell = W.partitionBy(*keys, "_cell")
    up = cell.orderBy("_seen", F.col("_halo").desc()).rowsBetween(FIRST, 0)
    down = cell.orderBy(F.col("_seen").desc(), F.col("_halo").desc()).rowsBetween(FIRST, 0)
    for name, (kind, column) in over.items():
        fold = _FOLDS[kind]
        inst = inst.withColumns({
            f"_a_{name}": fold(F.when(~F.col("_halo"), F.col(column))).over(up),
            f"_b_{name}": fold(F.when(F.col("_halo"), F.col(column))).over(down)})
    whole = {}
    for name, (kind, _) in over.items():
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        pair = F.least(a, b) if kind == "min" else F.greatest(a, b) if kind == "max" else F.coalesce(a + b, a, b)
        whole[name] = pair  # least and greatest pass over nulls
    extra = [f"_{x}_{name}" for name in over for x in "ab"]
    return inst.where(~F.col("_halo")).withColumns(whole).drop("_cell", "_halo", "_seen", *extra)


def drawdown(
    df: DataFrame, keys: list[str], order: list[str], value: str, parts: int | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Total and maximum drawdown of the running sum of ``value`` per key; the peak starts at 0.

    A bucket is folded to (sum, highest and lowest prefix, inner drawdown); these combine in order.
    """
    rows = df.select(*keys, *order, F.col(value).alias("_value"))
    return fold_drawdown(_folded(rows, keys, order, [F.col("_value")], parts, cuts), keys, BUCKET)


def drawdowns(
    df: DataFrame, keys: list[str], order: list[str], values: list[Column], parts: int | None = None, cuts: Cuts | None = None
) -> DataFrame:
    """:func:`drawdown` of every column of ``values`` (its place is ``point``), the rows being shuffled and sorted once for all.

    Nulls leave a running sum as it is.
    """
    return fold_drawdown(_folded(df, keys, order, values, parts, cuts), [*keys, "point"], BUCKET)


def _folded(df: DataFrame, keys: list[str], order: list[str], values: list[Column], parts: int | None, cuts: Cuts | None) -> DataFrame:
    """Summary of every bucket and ``point``."""
    group = keys + [BUCKET]
    # the columns are computed behind the shuffle, which so carries each row once
    rows = bucketed(df, order, parts, cuts).repartition(*group)
    n = range(len(values))
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(FIRST, 0)
    rows = rows.select(*group, *order, *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    rows = rows.select(*group, *order, *[f"_v{i}" for i in n], *[F.sum(f"_v{i}").over(w).alias(f"_p{i}") for i in n])
    rows = rows.select(*group, *[f"_v{i}" for i in n], *[f"_p{i}" for i in n], *[F.max(f"_p{i}").over(w).alias(f"_t{i}") for i in n])
    folded = rows.groupBy(*group).agg(*[
        F.struct(F.lit(i).alias("point"), F.sum(f"_v{i}").alias("s"), F.max(f"_p{i}").alias("hi"), F.min(f"_p{i}").alias("lo"),
                 F.max(F.col(f"_t{i}") - F.col(f"_p{i}")).alias("dd")).alias(f"_s{i}") for i in n])
    return folded.select(*group, F.inline(F.array(*[f"_s{i}" for i in n])))


def fold_drawdown(folded: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Combine block summaries (s, hi, lo, dd) along ``position`` into pnl and max_drawdown."""
    before = W.partitionBy(*keys).orderBy(position).rowsBetween(FIRST, -1)
    out = folded.withColumn("_base", F.coalesce(F.sum("s").over(before), F.lit(0)))
    out = out.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_base") + F.col("hi")).over(before), F.lit(0)), F.lit(0)))
    return out.groupBy(*keys).agg(
        F.sum("s").alias("pnl"),
        F.max(F.greatest(F.col("dd"), F.col("_peak") - F.col("_base") - F.col("lo"), F.lit(0))).alias("max_drawdown"),
    )


def ewma(
    df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float,
    start: float | None = None, parts: int | None = None,
) -> DataFrame:
    """Final exponentially weighted mean per key, seeded with ``start`` or the first value.

    A bucket of m rows acts on the state as x -> (1-a)^m * x + b, so buckets fold in order.
    """
    rows = bucketed(df, order, parts)
    group = keys + [BUCKET]
    keep = 1.0 - alpha
    up = W.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(up)).withColumn(
        "_m", F.count("*").over(W.partitionBy(*group))
    )
    weight = F.pow(F.lit(keep), (F.col("_m") - F.col("_i")).cast("double"))
    v = F.col(value).cast("double")
    part = rows.groupBy(*group).agg(
        F.count("*").alias("m"),
        F.sum(weight * v * alpha).alias("b"),
        # the very first row enters with full weight, so it is kept apart
        F.max(F.when(F.col("_i") == 1, v)).alias("first"),
    )
    steps = F.array_sort(F.collect_list(F.struct(F.col(BUCKET).alias("k"), "m", "b", "first")))
    seed = F.lit(float(start)) if start is not None else F.element_at("_steps", 1)["first"]
    folded = F.aggregate("_steps", seed, lambda x, s: x * F.pow(F.lit(keep), s["m"].cast("double")) + s["b"])
    return part.groupBy(*keys).agg(steps.alias("_steps"), F.sum("m").alias("n")).select(
        *keys, "n", folded.alias("ewma")
    )


def rank_percentiles(
    df: DataFrame, keys: list[str], value: str, qs: dict[str, float], rule: str = "nearest",
    parts: int | None = None,
) -> DataFrame:
    """Exact order statistics per key as columns ``qs``.

    Rules for the index into the sorted values: "nearest" round((n-1)q), "floor" min(floor(n q),
    n-1). Equal values are counted first, so a hot value is one row of the cumulative count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cum = running(counts, keys, [value], {"_cum": ("sum", "_c")}, parts, totals={"_n": "_c"})
    picks = []
    for name, q in qs.items():
        at = F.round((F.col("_n") - 1) * q) if rule == "nearest" else F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)
        hit = (F.col("_cum") - F.col("_c") <= at) & (F.col("_cum") > at)
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    return cum.groupBy(*keys).agg(*picks)


ACCURACY = 10_000  # of the approximate quantiles that bracket an exact one


def brackets(value: Column, qs: dict[str, float]) -> dict[str, Column]:
    """Aggregates for :func:`bracketed_percentiles`: ``_n`` counts the values, ``_at`` holds a lower and an upper bound of every quantile."""
    off = 3.0 / ACCURACY
    near = [min(max(q + d, 0.0), 1.0) for q in qs.values() for d in (-off, off)]
    return {"_n": F.count(value), "_at": F.percentile_approx(value, near, ACCURACY)}


def bracketed_percentiles(df: DataFrame, keys: list[str], value: str, known: DataFrame, qs: dict[str, float], parts: int | None = None) -> DataFrame:
    """Exact order statistics ("nearest") per key, as :func:`rank_percentiles` gives them, without a shuffle of the values.

    ``known`` holds :func:`brackets` per key. Values below a bracket are only counted; those inside, a
    small share of the rows and the equal ones, tell the quantile. If a bracket misses it, all values
    are counted. Keys are joined as SQL does, so a null key has no row.
    """
    names = list(qs)
    rows = df.select(*keys, F.col(value).alias("_v")).join(small(known.where("_n > 0").select(*keys, "_n", "_at")), keys)
    lo, hi = ([F.get("_at", F.lit(2 * j + k)) for j in range(len(names))] for k in (0, 1))
    below = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.count_if(F.col("_v") < x).alias(f"_below_{q}") for q, x in zip(names, lo)])
    inside = rows.select(*keys, "_v", F.explode(F.array_compact(F.array(*[
        F.when(F.col("_v").between(x, y), F.lit(q)) for q, x, y in zip(names, lo, hi)]))).alias("_q"))
    inside = inside.groupBy(*keys, "_q", "_v").agg(F.count("*").alias("_c"))
    upto = W.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(FIRST, 0)
    inside = inside.withColumn("_cum", F.sum("_c").over(upto))
    c = F.col
    picks = []
    for q, share in qs.items():
        at = F.round((c("_n") - 1) * share) - c(f"_below_{q}")
        picks.append(F.max(F.when((c("_q") == q) & (c("_cum") - c("_c") <= at) & (c("_cum") > at), c("_v"))).alias(q))
    out = stage(inside.join(below, keys).groupBy(*keys).agg(*picks))
    if out.where(" OR ".join(f"{q} IS NULL" for q in names)).isEmpty():
        return out
    return rank_percentiles(df, keys, value, qs, parts=parts)


def newest(df: DataFrame, keys: list[str], order: list[str], n: int, parts: int | None = None) -> DataFrame:
    """The newest ``n`` rows per key, along ``order`` rising, without sorting a whole key in one task.

    The per-bucket counts tell in which buckets the newest rows lie; only those are ranked.
    """
    rows = bucketed(df, order, parts)
    group = keys + [BUCKET]
    after = W.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(FIRST, -1)
    base = rows.groupBy(*group).agg(F.count("*").alias("_c"))
    base = base.select(*group, F.coalesce(F.sum("_c").over(after), F.lit(0)).alias("_o")).where(F.col("_o") < n)
    inside = W.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    out = _same(rows, base, group).withColumn("newest", F.col("_o") + F.row_number().over(inside))
    return out.where(F.col("newest") <= n).drop("_o", BUCKET)
