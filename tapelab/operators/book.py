"""Order books: rebuilding from snapshots and deltas, sequence and order checks."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab.functions.quality import BOOK_DEPTH, PRICE_SCALE, price_key
from tapelab.operators.ordered import BUCKET, FIRST, bucketed, range_cuts, running
from tapelab.session import small, stage

LEVELS = "array<struct<price:double,qty:double>>"
OUT = f"bid double, bid_qty double, ask double, ask_qty double, bids {LEVELS}, asks {LEVELS}"
MARKET = ["venue", "pair"]
EPOCH = "_epoch"
BEHIND = 1 << 62  # no price
KEYED = "array<bigint>"
BOOK = f"bid_keys {KEYED}, bid_sizes array<double>, ask_keys {KEYED}, ask_sizes array<double>"
TOP = ("bid", "bid_qty", "ask", "ask_qty")


def snapshot_books(events: DataFrame) -> DataFrame:
    """Books of a tape that holds only snapshots: each message is the whole book, no state."""

    def clean(levels):
        # a later level of the same price replaces an earlier one; size 0 removes it
        keys = F.transform(levels, lambda x: price_key(x["price"]))
        last = F.filter(levels, lambda x, i: ~F.exists(F.slice(levels, i + 2, F.size(levels)), lambda y: price_key(y["price"]) == price_key(x["price"])))
        one = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.col(levels)).otherwise(last)
        return F.slice(F.filter(one, lambda x: x["qty"] != 0), 1, BOOK_DEPTH)

    df = events.withColumns({"bids": clean("bids"), "asks": clean("asks")})
    top = {"bid": ("bids", "price"), "bid_qty": ("bids", "qty"), "ask": ("asks", "price"), "ask_qty": ("asks", "qty")}
    return df.withColumns({k: F.get(F.col(a), F.lit(0))[b] for k, (a, b) in top.items()})


def rebuild_books(
    events: DataFrame, order: list[str] | None = None, depth: int = BOOK_DEPTH, trim: bool = True,
    strict: bool = False, parts: int | None = None,
) -> DataFrame:
    """Book after every message: snapshot clears both sides, size 0 deletes, best ``depth`` kept.

    ``order`` is [time, sequence]. What a message cuts off is gone for good, so a book depends on all
    that came before. Messages are cut into chunks (market and bucket) all the same, and the book
    at the start of every chunk is found first, by guess and proof:

    1. Guess: the chunks' last updates per price, laid over each other in order and trimmed.
    2. Every chunk is folded from its guess, all in parallel, to its last book and its floor: the best
       price that the worst of ``depth`` kept levels had after any message (see :class:`_Books`).
       Levels behind the floor were cut off there whatever book the chunk started with.
    3. The chunks' results are read in order, one row per chunk. Where a chunk's start was guessed
       wrong, its last book still holds if the best wrong price lies behind the floor; if not, the chunk is
       folded again from the better start. This repeats until nothing is left to fold.
    4. The starts are exact then, and all chunks are folded to their output in parallel.

    Rounds of step 3 are few where books are full or snapshots come now and then; a chain of
    chunks whose books are never full and all hang on one wrong level takes a round each.
    ``strict`` folds every epoch (a snapshot and what follows up to the next one) in order in one task
    instead, ``trim=False`` cuts off nothing but what is shown. The result does not depend on buckets.
    """
    order = order or ["t", "seq"]
    ev = events.withColumn("_snap", (F.col("kind") == "snapshot").cast("int"))
    names = [f.name for f in events.schema.fields if f.name not in ("bids", "asks", *TOP)]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields if f.name in names)
    schema = f"{head}, {OUT}"
    if not trim:
        return _in_buckets(ev, order, parts, names, schema, depth)
    if strict:
        ev = stage(running(ev, MARKET, order, {EPOCH: ("sum", "_snap")}, parts))
        return _in_order(ev, MARKET + [EPOCH], order, names, schema, depth)
    ev = stage(bucketed(ev, order, parts))
    rows = _entered(ev, _starts(ev, order, depth), names)
    return rows.groupBy(*MARKET, BUCKET).applyInArrow(_shown(order, names, depth, depth), schema)


class _Books:
    """Both sides of one book: sizes by price and prices in book order (bids negated).

    ``floor`` is per side the best price that the worst of ``depth`` levels had after a message.
    Levels better than a price evolve without regard to those behind it, as only the worst are cut
    off. So two books that differ only behind the floor are the same from the message of the floor on.
    A snapshot sets the floor before every price.
    """

    def __init__(self):
        self.size: list[dict[int, float]] = [{}, {}]
        self.keys: list[list[int]] = [[], []]
        self.floor = [BEHIND, BEHIND]

    def clear(self):
        self.floor = [-BEHIND, -BEHIND]
        for side in (0, 1):
            self.size[side].clear()
            self.keys[side].clear()

    def apply(self, side: int, price: list[int], qty: list[float], depth: int | None):
        size, keys, sign = self.size[side], self.keys[side], 1 if side else -1
        if not keys and len(price) > 8:  # a snapshot, or a carried book
            size.update(zip((sign * p for p in price), qty))
            for k in [k for k, q in size.items() if q == 0]:
                del size[k]
            keys.extend(sorted(size))
        else:
            for p, q in zip(price, qty):
                k = sign * p
                if q == 0:
                    if size.pop(k, None) is not None:
                        del keys[bisect_left(keys, k)]
                else:
                    if k not in size:
                        insort(keys, k)
                    size[k] = q
        if depth is not None and len(keys) >= depth:
            for k in keys[depth:]:
                del size[k]
            del keys[depth:]
            self.floor[side] = min(self.floor[side], keys[-1])


class _Out:
    """Books of the messages of one batch as Arrow columns."""

    def __init__(self):
        self.sides = [([0], [], []), ([0], [], [])]

    def add(self, books: _Books, depth: int):
        for side, (offs, ks, qs) in enumerate(self.sides):
            top = books.keys[side][:depth]
            size = books.size[side]
            ks.extend(top)
            qs.extend([size[k] for k in top])
            offs.append(len(ks))

    def columns(self) -> dict:
        cols, levels = {}, []
        for side, (offs, ks, qs) in enumerate(self.sides):
            o, p, q = np.array(offs, np.int32), np.abs(np.array(ks, np.float64)) / PRICE_SCALE, np.array(qs, np.float64)
            has = o[1:] > o[:-1]
            at = np.minimum(o[:-1], max(len(p) - 1, 0))
            for name, v in zip(TOP[2 * side:2 * side + 2], (p, q)):
                first = v[at] if len(v) else np.zeros(len(has))
                cols[name] = pa.array(first, mask=~has)
            levels.append(pa.ListArray.from_arrays(pa.array(o), pa.StructArray.from_arrays([pa.array(p), pa.array(q)], ["price", "qty"])))
        return cols | {"bids": levels[0], "asks": levels[1]}


def _in_order(ev: DataFrame, epoch: list[str], order: list[str], names: list[str], schema: str, depth: int) -> DataFrame:
    """Every epoch folded in its order; a task streams its batches and keeps one book."""
    rows = ev.repartition(*epoch).sortWithinPartitions(*epoch, *order)

    def fold(batches):
        books, now = _Books(), None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in epoch)))
            sides = [_flat(batch.column("bids")), _flat(batch.column("asks"))]
            out = _Out()
            for i, (key, snap) in enumerate(zip(keys, batch.column("_snap").to_pylist())):
                if snap == 1 or key != now:
                    books.clear()
                    now = key
                for side, (offs, price, qty) in enumerate(sides):
                    a, b = offs[i], offs[i + 1]
                    if b > a:
                        books.apply(side, price[a:b], qty[a:b], depth)
                out.add(books, depth)
            cols = out.columns()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols.values()], names=[*names, *cols])

    return rows.select(*names, EPOCH, "_snap", "bids", "asks").mapInArrow(fold, schema)


def _in_buckets(ev: DataFrame, order: list[str], parts: int | None, names: list[str], schema: str, depth: int) -> DataFrame:
    """Books by chunk, from the carried book at its start; nothing is cut off but in what is shown."""
    ev = bucketed(ev.drop(EPOCH), order, parts)
    rows = _entered(ev, _carried(ev, order), names)
    return rows.groupBy(*MARKET, BUCKET).applyInArrow(_shown(order, names, depth, None), schema)


def _entered(ev: DataFrame, starts: DataFrame, names: list[str]) -> DataFrame:
    """Messages of chunks, each chunk preceded by a pseudo message with its book at the start."""
    starts = starts.withColumns({"_snap": F.lit(0), "_carry": F.lit(0)})
    rows = ev.withColumn("_carry", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    return rows.select(*MARKET, BUCKET, *[n for n in names if n not in MARKET], "bids", "asks", "_snap", "_carry")


def _folded(table: pa.Table, order: list[str], kept: int | None, out: Callable | None = None) -> tuple[pa.Table, _Books]:
    """Folds a chunk; ``out`` is told the book after every message."""
    table = table.sort_by([(c, "ascending") for c in ("_carry", *order)]).combine_chunks()
    sides = [_flat(table["bids"]), _flat(table["asks"])]
    books = _Books()
    for i, (snap, carry) in enumerate(zip(table["_snap"].to_pylist(), table["_carry"].to_pylist())):
        if snap == 1:
            books.clear()
        for side, (offs, price, qty) in enumerate(sides):
            a, b = offs[i], offs[i + 1]
            if b > a:
                books.apply(side, price[a:b], qty[a:b], kept if carry else None)
        if carry and out is not None:
            out(books)
    return table, books


def _shown(order: list[str], names: list[str], depth: int, kept: int | None):
    def fold(table: pa.Table) -> pa.Table:
        out = _Out()
        table, _ = _folded(table, order, kept, lambda books: out.add(books, depth))
        rows = table.filter(pc.equal(table["_carry"], 1)).select(names)
        return pa.table({n: rows[n] for n in names} | out.columns())

    return fold


def _starts(ev: DataFrame, order: list[str], depth: int) -> DataFrame:
    """The exact book at the start of every chunk of ``ev`` (market, bucket, bids, asks), by guess and proof."""
    keys = [*MARKET, BUCKET]

    def ended(table: pa.Table) -> pa.Table:
        _, books = _folded(table, order, depth)
        row = {c: table[c][:1] for c in keys}
        for side, name in enumerate(("bid", "ask")):
            row[f"{name}_keys"] = pa.array([books.keys[side]], pa.list_(pa.int64()))
            row[f"{name}_sizes"] = pa.array([[books.size[side][k] for k in books.keys[side]]], pa.list_(pa.float64()))
            row[f"{name}_floor"] = pa.array([books.floor[side]], pa.int64())
        return pa.table(row)

    head = ", ".join(f"{c} {ev.schema[c].dataType.simpleString()}" for c in keys)
    proved, todo = stage(_guesses(ev, order, depth, head)), None
    folds = None
    while True:
        open_ = proved if todo is None else proved.where("_again").drop("_again")
        rows = ev if todo is None else ev.join(small(todo.select(*keys)), keys, "left_semi")
        new = rows_of_chunks(rows, open_, order).groupBy(*keys).applyInArrow(ended, f"{head}, {BOOK}, bid_floor bigint, ask_floor bigint")
        used = open_.select(*keys, *[F.col(c).alias(f"_{c}") for c in BOOK_COLUMNS])
        new = new.join(used, keys)
        folds = stage(new if folds is None else new.unionByName(folds.join(small(todo.select(*keys)), keys, "left_anti")))
        proved = stage(folds.groupBy(*MARKET).applyInPandas(_prove, f"{head}, {BOOK}, _again boolean"))
        todo = proved.where("_again")
        if todo.isEmpty():
            return proved.select(*keys, *_levels())


BOOK_COLUMNS = ("bid_keys", "bid_sizes", "ask_keys", "ask_sizes")


def _levels() -> list[Column]:
    """Keys and sizes as the price levels ``bids`` and ``asks``."""
    pair = lambda k, q: F.struct((F.abs(k) / PRICE_SCALE).alias("price"), q.alias("qty"))
    return [F.zip_with(f"{name}_keys", f"{name}_sizes", pair).alias(f"{name}s") for name in ("bid", "ask")]


def rows_of_chunks(ev: DataFrame, starts: DataFrame, order: list[str]) -> DataFrame:
    """Messages and starts with what a fold to the last book needs."""
    return _entered(ev, starts.select(*MARKET, BUCKET, *_levels()), [*MARKET, *order])


def _guesses(ev: DataFrame, order: list[str], depth: int, head: str) -> DataFrame:
    """Per chunk a guess at the book at its start: last updates per price of the chunks before, trimmed chunk by chunk.

    A task reads one row per price and chunk of its markets, in order, and holds one book.
    """
    group = [*MARKET, BUCKET]
    at = F.struct(*[F.col(c) for c in order])
    last = _last_updates(ev, group, at).select(*group, "_side", "_p", "_u.qty", F.col("_u._at").alias("_at"))
    marks = ev.groupBy(*group).agg(F.max(F.when(F.col("_snap") == 1, at)).alias("_cleared"))
    last = last.join(marks, group).where(F.col("_cleared").isNull() | (F.col("_at") >= F.col("_cleared")))
    rows = last.select(*group, F.when(F.col("_side") == "bids", 0).otherwise(1).alias("_side"), F.col("_p"), "qty").unionByName(
        marks.select(*group, F.when(F.col("_cleared").isNull(), -1).otherwise(-2).alias("_side"), F.lit(None).cast("bigint").alias("_p"), F.lit(None).cast("double").alias("qty")))
    rows = rows.repartition(*MARKET).sortWithinPartitions(*group, "_side")

    def lay(batches):
        now, market, books = None, None, _Books()
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in (*group, "_side", "_p", "qty")]
            for venue, pair, bucket, side, price, qty in zip(*cols):
                if side < 0:  # the chunk's first row
                    if (venue, pair) != market:
                        market, books = (venue, pair), _Books()
                    for s in (0, 1):
                        books.apply(s, [], [], depth)
                    out.append((venue, pair, bucket, *_columns(books)))
                    if side == -2:
                        books.clear()
                else:
                    books.apply(side, [price], [qty], None)
            if out:
                kinds = [b.schema.field(c).type for c in group] + [pa.list_(pa.int64()), pa.list_(pa.float64())] * 2
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=[*group, *BOOK_COLUMNS])

    return rows.mapInArrow(lay, f"{head}, {BOOK}")


def _columns(books: _Books) -> list:
    return [x for side in (0, 1) for x in (list(books.keys[side]), [books.size[side][k] for k in books.keys[side]])]


def _prove(rows: pd.DataFrame) -> pd.DataFrame:
    """Reads a market's chunks in order: their starts as far as known, and which have to be folded again."""
    rows = rows.sort_values(BUCKET)
    out, known = [], [[], [], [], []]
    for r in rows.to_dict("records"):
        again = False
        for side, name in enumerate(("bid", "ask")):
            mine, used = (dict(zip(k, q)) for k, q in ((known[2 * side], known[2 * side + 1]), (r[f"_{name}_keys"], r[f"_{name}_sizes"])))
            wrong = min((k for k in mine.keys() | used.keys() if mine.get(k) != used.get(k)), default=None)
            again |= wrong is not None and wrong <= r[f"{name}_floor"]
        out.append((*(r[c] for c in (*MARKET, BUCKET)), *known, again))
        known = [list(r[c]) for c in BOOK_COLUMNS]
    return pd.DataFrame(out, columns=[*MARKET, BUCKET, *BOOK_COLUMNS, "_again"])


def _flat(column) -> tuple[list[int], list[int], list[float]]:
    """Offsets, scaled prices and sizes of a list<struct<price, qty>> column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    price = np.rint(flat.field("price").to_numpy(zero_copy_only=False) * PRICE_SCALE).astype(np.int64)
    return [0, *np.cumsum(counts).tolist()], price.tolist(), flat.field("qty").to_numpy(zero_copy_only=False).tolist()


def _last_updates(ev: DataFrame, group: list[str], at: Column) -> DataFrame:
    """The last update of every price of a side in a group, as struct _u (_at, _i, qty)."""

    def side(name):
        lv = ev.select(*group, at.alias("_at"), F.posexplode(name).alias("_i", "_l"))
        return lv.select(*group, F.lit(name).alias("_side"), price_key("_l.price").alias("_p"),
                         F.struct(F.col("_at"), F.col("_i"), F.col("_l.qty").alias("qty")).alias("_u"))

    return side("bids").unionByName(side("asks")).groupBy(*group, "_side", "_p").agg(F.max("_u").alias("_u"))


def _carried(ev: DataFrame, order: list[str]) -> DataFrame:
    """One pseudo message per (market, bucket) with the book at the bucket's start."""
    group = MARKET + [BUCKET]
    at = F.struct(*[F.col(c) for c in order])
    marks = ev.groupBy(*group).agg(F.max(F.when(F.col("_snap") == 1, at)).alias("_cleared"))
    w = W.partitionBy(*MARKET).orderBy(BUCKET).rowsBetween(FIRST, -1)
    marks = marks.withColumn("_since", F.last("_cleared", ignorenulls=True).over(w))

    last = _last_updates(ev, group, at)
    # an update holds until the next bucket that touches the same price
    until = F.lead(BUCKET).over(W.partitionBy(*MARKET, "_side", "_p").orderBy(BUCKET))
    last = last.withColumn("_until", until).where(F.col("_u.qty") != 0)
    # buckets of the market that start while the update holds; equi-join on the market and then a
    # range of bucket numbers: rows made = (levels in the book) x (buckets), the carry itself
    spans = last.withColumn("_to", F.coalesce("_until", F.lit(2**31 - 1)))
    seen = marks.groupBy(*MARKET).agg(F.sort_array(F.collect_list(F.col(BUCKET))).alias("_all"))
    spans = spans.join(seen, MARKET).withColumn(
        "_home", F.explode(F.filter("_all", lambda b: (b > F.col(BUCKET)) & (b <= F.col("_to"))))
    ).drop(BUCKET, "_all").withColumnRenamed("_home", BUCKET)
    spans = spans.join(marks.select(*group, "_since"), group)
    spans = spans.where(F.col("_since").isNull() | (F.col("_u._at") >= F.col("_since")))
    level = F.struct((F.col("_p") / PRICE_SCALE).alias("price"), F.col("_u.qty").alias("qty"))
    return spans.groupBy(*group).agg(
        F.collect_list(F.when(F.col("_side") == "bids", level)).alias("bids"),
        F.collect_list(F.when(F.col("_side") == "asks", level)).alias("asks"),
    )


def sequence_status(events: DataFrame, rule: str, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Status of every message under a sequence rule; ``accepted`` tells whether it counts.

    Rules: "exact" (previous + 1), "monotone" (not lower), "linked" (names its predecessor).
    Snapshots start an epoch. In an epoch the last accepted number is the running maximum as long
    as no gap was seen, so the rule needs running maxima only, not a sequential scan. After a gap
    every message waits for the next snapshot. Input: kind, sequence, previous.
    """
    order = order or ["t", "seq"]
    ev = events.withColumn("_snap", (F.col("kind") == "snapshot").cast("int"))
    cuts = range_cuts(events, order, parts)
    ev = running(ev, MARKET, order, {"epoch": ("sum", "_snap")}, cuts=cuts)
    keys = MARKET + ["epoch"]
    ev = running(ev, keys, order, {"_last": ("max", "sequence")}, exclusive=True, cuts=cuts)
    c = F.col
    snap = c("_snap") == 1
    known = c("_last").isNotNull() & c("sequence").isNotNull() & ~snap
    if rule == "exact":
        gap = known & (c("sequence") > c("_last") + 1)
        late = known & (c("sequence") <= c("_last"))
        good = "secuencia_continua"
    elif rule == "monotone":
        gap = F.lit(False)
        late = known & (c("sequence") < c("_last"))
        good = "secuencia_monotona"
    else:
        gap = known & c("previous").isNotNull() & ((c("previous") != c("_last")) | (c("sequence") <= c("_last")))
        late = F.lit(False)
        good = "secuencia_enlazada"
    ev = ev.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int"))
    if rule == "monotone":
        ev = ev.withColumn("_broken", F.lit(0))
    else:
        ev = running(ev, keys, order, {"_broken": ("max", "_gap")}, exclusive=True, cuts=cuts)
    missing = c("sequence").isNull() if rule != "linked" else c("sequence").isNull() | c("previous").isNull()
    status = (
        F.when(snap, "snapshot").when(F.coalesce(c("_broken"), F.lit(0)) == 1, "esperando_snapshot")
        .when(missing, "secuencia_no_disponible").when(late, "fuera_de_orden")
        .when(c("_gap") == 1, "gap_requiere_snapshot").otherwise(good)
    )
    bad = ["esperando_snapshot", "fuera_de_orden", "gap_requiere_snapshot"]
    return ev.withColumn("status", status).withColumn("accepted", ~F.col("status").isin(bad)).drop(
        "_snap", "_last", "_gap", "_broken")


def order_failures(events: DataFrame, line: list[str], parts: int | None = None) -> DataFrame:
    """Messages whose local time or sequence steps back, in recorded (``line``) order per market."""
    prev = running(events, MARKET, line, {"_t": ("max", "t"), "_s": ("max", "sequence")}, parts, exclusive=True)
    why = F.array_compact(F.array(
        F.when(F.col("t") < F.col("_t"), F.lit("time_order")),
        F.when(~F.col("resync") & (F.col("sequence") < F.col("_s")), F.lit("sequence_order")),
    ))
    return prev.withColumn("failure", F.explode(why)).drop("_t", "_s")
