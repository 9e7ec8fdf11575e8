"""Ledger audits: hash chain, duplicates, totals, balances, average-cost results.

Ledger events are rows (ledger, sequence, id, ...); several ledgers are audited together, and a
ledger with a third of all events is spread over buckets of its sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.operators.ordered import BUCKET, bucketed, ranked, running, running_sum
from tapelab.session import small, stage

GENESIS = "GENESIS"
UNITS = 10**10  # of a quantity


def with_previous(events: DataFrame, keys: list[str], order: list[str], column: str, parts: int | None = None) -> DataFrame:
    """Add ``position`` (1-based) and ``before``, the previous row's ``column``, per ledger."""
    rows = ranked(events, keys, order, parts)
    nxt = rows.select(*keys, (F.col("rank") + 1).alias("rank"), F.col(column).alias("before"))
    out = rows.join(nxt, [*keys, "rank"], "left")
    return out.withColumn("position", F.col("rank") + 1).drop("rank", "n")


def chain_errors(events: DataFrame, text: Column, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(ledger, id, error): wrong sequence, broken link, wrong hash.

    A row is checked against the stored hash before it, so all rows are checked in parallel.
    Input: ledger, sequence, id, previous, hash.
    """
    rows = with_previous(events, ["ledger"], order or ["position"], "hash", parts)
    link = F.when(F.col("position") == 1, F.lit(GENESIS)).otherwise(F.col("before"))
    why = F.array_compact(F.array(
        F.when(F.col("sequence") != F.col("position"), F.lit("sequence")), F.when(~F.col("previous").eqNullSafe(link), F.lit("chain")),
        F.when(~F.col("hash").eqNullSafe(F.sha2(text, 256)), F.lit("hash"))))
    return rows.select("ledger", "id", F.explode(why).alias("error"))


def duplicates(events: DataFrame, key: str, error: str) -> DataFrame:
    d = events.where(F.col(key).isNotNull()).groupBy("ledger", key).agg(F.count("*").alias("_n")).where("_n > 1")
    return d.select("ledger", F.col(key).alias("id"), F.lit(error).alias("error"))


def head_errors(events: DataFrame, heads: DataFrame) -> DataFrame:
    """Ledgers whose declared count or head hash differs (heads: ledger, event_count, head_hash)."""
    a = events.groupBy("ledger").agg(F.count("*").alias("_n"), F.max_by("hash", "sequence").alias("_h"))
    j = heads.join(a, "ledger", "left")
    why = F.array_compact(F.array(
        F.when(F.coalesce("_n", F.lit(0)) != F.col("event_count"), F.lit("count")), F.when(~F.coalesce("_h", F.lit(GENESIS)).eqNullSafe(F.col("head_hash")), F.lit("head"))))
    return j.select("ledger", F.lit("").alias("id"), F.explode(why).alias("error"))


def totals(events: DataFrame) -> DataFrame:
    """Recomputed sums per ledger. Input: kind, side, qty, price, reference, fee, cost."""
    c = F.col
    notional = c("qty") * c("price")
    fill = c("kind") == "fill"

    def s(cond, v):
        return F.coalesce(F.sum(F.when(cond, v)), F.lit(0))

    buy, sell = fill & (c("side") == "buy"), fill & (c("side") == "sell")
    slip = F.when(c("side") == "buy", (c("price") - c("reference")) * c("qty")).otherwise((c("reference") - c("price")) * c("qty"))
    return events.groupBy("ledger").agg(
        s(buy, notional).alias("bought"), s(sell, notional).alias("sold"), s(buy, c("fee")).alias("buy_fees"), s(sell, c("fee")).alias("sell_fees"),
        s(fill, slip).alias("slippage"), s(c("kind") == "rebalance", c("cost")).alias("rebalance_cost"),
        s(c("kind") == "withdrawal_amortization", c("cost")).alias("withdrawal_cost"),
        (s(buy, c("qty")) - s(sell, c("qty"))).alias("residual"))


def usable_fill() -> Column:
    """Fills with unusable amounts are errors and do not move balances."""
    c = F.col
    return ~((c("kind") == "fill") & ((c("qty") <= 0) | (c("price") <= 0) | (c("fee") < 0)))


def deltas(events: DataFrame) -> DataFrame:
    """Balance changes per event and venue (a rebalance changes two venues)."""
    c = F.col
    n = c("qty") * c("price")
    zero = F.lit(0)
    buy = F.struct(c("venue").alias("at"), c("qty").alias("btc"), (-(n + c("fee"))).alias("usd"))
    sell = F.struct(c("venue").alias("at"), (-c("qty")).alias("btc"), (n - c("fee")).alias("usd"))
    out = F.struct(c("venue").alias("at"), (-c("btc")).alias("btc"), (-(c("usd") + c("cost"))).alias("usd"))
    into = F.struct(c("to_venue").alias("at"), c("btc").alias("btc"), c("usd").alias("usd"))
    fee = F.struct(c("venue").alias("at"), zero.alias("btc"), (-c("cost")).alias("usd"))
    both = F.when((c("kind") == "fill") & (c("side") == "buy"), F.array(buy)).when(c("kind") == "fill", F.array(sell)).when(
        c("kind") == "rebalance", F.array(out, into)).otherwise(F.array(fee))
    return events.where(usable_fill()).select("ledger", "sequence", "id", F.inline(both))


def running_balances(changes: DataFrame, initial: DataFrame, parts: int | None = None) -> DataFrame:
    """Balance of every venue after each event that changes it. ``initial``: ledger, at, btc, usd.

    An event that touches a venue twice (a transfer into itself) is one change of that venue.
    """
    changes = changes.groupBy("ledger", "sequence", "id", "at").agg(F.sum("btc").alias("btc"), F.sum("usd").alias("usd"))
    start = initial.select("ledger", F.lit(0).cast("bigint").alias("sequence"), F.lit("").alias("id"), "at", "btc", "usd")
    rows = changes.unionByName(start)
    out = running_sum(rows, ["ledger", "at"], ["sequence"], {"btc_after": "btc", "usd_after": "usd"}, parts)
    return out.where("sequence > 0").select("ledger", "sequence", "id", "at", "btc_after", "usd_after")


def negative_balances(balances: DataFrame) -> DataFrame:
    return balances.where("btc_after < 0 OR usd_after < 0").select("ledger", "id", F.lit("negative_balance").alias("error"))


def final_balances(changes: DataFrame, initial: DataFrame) -> DataFrame:
    rows = changes.select("ledger", "at", "btc", "usd").unionByName(initial.select("ledger", "at", "btc", "usd"))
    return rows.groupBy("ledger", "at").agg(F.sum("btc").alias("btc"), F.sum("usd").alias("usd"))


def result_check(final: DataFrame, initial: DataFrame, declared: DataFrame, heads: DataFrame) -> DataFrame:
    """Recomputed result and whether result and final balances match what the ledger states.

    ``heads``: ledger, mark, reported. ``declared``: ledger, at, btc, usd.
    """
    def sums(df, p):
        return df.groupBy("ledger").agg(F.sum("btc").alias(f"{p}b"), F.sum("usd").alias(f"{p}u"))

    j = heads.join(sums(final, "f"), "ledger", "left").join(sums(initial, "i"), "ledger", "left")
    d = declared.select("ledger", "at", F.col("btc").alias("_b"), F.col("usd").alias("_u"), F.lit(1).alias("_d"))
    m = final.withColumn("_f", F.lit(1)).join(d, ["ledger", "at"], "full")
    ok = F.col("_f").isNotNull() & F.col("_d").isNotNull() & (F.col("btc") == F.col("_b")) & (F.col("usd") == F.col("_u"))
    same = m.groupBy("ledger").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("balances_match"))
    residual = F.col("fb") - F.col("ib")
    net = F.col("fu") - F.col("iu") + residual * F.col("mark")
    return j.join(same, "ledger", "left").select(
        "ledger", residual.alias("residual"), net.alias("recomputed"), "reported", (net == F.col("reported")).alias("result_matches"), "balances_match")


def average_cost(fills: DataFrame, mark: float | Column = 0.0, parts: int | None = None) -> DataFrame:
    """Realised and open result per ledger with average cost; a sale without stock is an error.

    Stock is a running sum. While it never goes short, the cost of the stock changes by
    x -> x + paid on a purchase and x -> x (1 - q / stock) on a sale. Such steps combine, so the
    buckets of a ledger are folded apart and then in order. Where a ledger does go short, which sales
    count depends on the stock a bucket starts with; see :func:`_exact_stock`, which finds that
    first. Quantities count to ten decimals there. Input: ledger, sequence, side, qty, notional, fee.
    """
    c = F.col
    signed = F.when(c("side") == "buy", c("qty")).otherwise(-c("qty"))
    rows = running(fills.withColumn("_q", signed), ["ledger"], ["sequence"], {"_stock": ("sum", "_q")}, parts)
    low = rows.groupBy("ledger").agg(F.min("_stock").alias("_low"))
    good = low.where("_low >= 0").select("ledger")
    short = low.where("_low < 0").select("ledger")
    clean = _fold_cost(rows.join(good, "ledger", "left_semi"), parts)
    dirty = _short_cost(fills.join(short, "ledger", "left_semi"), parts)
    out = clean.unionByName(dirty)
    open_ = F.when(c("stock") > 0, c("stock") * mark - c("cost")).otherwise(0.0)
    return out.withColumn("unrealized", open_)


def _fold_cost(rows: DataFrame, parts: int | None) -> DataFrame:
    c = F.col
    before = (c("_stock") - c("_q")).cast("double")
    buy = c("side") == "buy"
    a = F.when(buy, 1.0).otherwise(1.0 - c("qty").cast("double") / before)
    b = F.when(buy, (c("notional") + c("fee")).cast("double")).otherwise(0.0)
    rows = bucketed(rows.withColumns({"_a": a, "_b": b}), ["sequence"], parts)
    step = F.array_sort(F.collect_list(F.struct("sequence", "_a", "_b")))
    fold = lambda acc, s: F.struct((acc["a"] * s["_a"]).alias("a"), (acc["b"] * s["_a"] + s["_b"]).alias("b"))
    unit = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    paid = F.sum(F.when(buy, (c("notional") + c("fee")).cast("double")).otherwise(0.0))
    got = F.sum(F.when(buy, 0.0).otherwise((c("notional") - c("fee")).cast("double")))
    part = rows.groupBy("ledger", BUCKET).agg(step.alias("_s"), paid.alias("_paid"), got.alias("_got"), F.sum("_q").alias("_dq"))
    part = part.withColumn("_f", F.aggregate("_s", unit, fold)).drop("_s").withColumn("_bad", F.lit(0).cast("bigint"))
    return _chained(part.withColumn("_dq", c("_dq").cast("double")))


def _chained(part: DataFrame) -> DataFrame:
    """Combines buckets, cost -> a cost + b each, along a ledger. Input: _f (a, b), _paid, _got, _dq, _bad."""
    c = F.col
    chain = F.array_sort(F.collect_list(F.struct(F.col(BUCKET).alias("k"), "_f")))
    cost = F.aggregate("_c", F.lit(0.0), lambda x, s: x * s["_f"]["a"] + s["_f"]["b"])
    out = part.groupBy("ledger").agg(chain.alias("_c"), F.sum("_paid").alias("_paid"), F.sum("_got").alias("_got"), F.sum("_dq").alias("stock"),
                                    F.sum("_bad").alias("bad_sales"))
    out = out.withColumn("cost", cost)
    # released cost = everything paid minus what is still in stock
    return out.select("ledger", "stock", "cost", (c("_got") - (c("_paid") - c("cost"))).alias("realized"), "bad_sales")


def _walked(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Fills of one bucket in order: (is a purchase, units, notional, fee)."""
    pdf = pdf.sort_values("sequence", kind="stable")
    return zip((pdf["side"] == "buy").tolist(), map(int, pdf["_units"]), pdf["notional"].astype(float).tolist(), pdf["fee"].astype(float).tolist())


def _stock_piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one bucket does to the stock, from the stock it is said to start with.

    The same sales count for every start from ``_low`` to below ``_high``; there the stock changes by
    ``_net``. From ``_safe`` on all sales count and it changes by ``_sum``.
    """
    start = stock = int(pdf["_start"].iloc[0])
    low, high, total, safe = 0, None, 0, 0
    for buy, q, _, _ in _walked(pdf):
        if buy:
            stock, total = stock + q, total + q
            continue
        safe = max(safe, q - total)
        total -= q
        if stock < q:
            high = min(high, start + q - stock) if high is not None else start + q - stock
        else:
            low = max(low, start - (stock - q))
            stock -= q
    values = [pdf["ledger"].iloc[0], pdf[BUCKET].iloc[0], *(None if v is None else Decimal(v) for v in (start, low, high, stock - start, safe, total))]
    return pd.DataFrame([values], columns=["ledger", BUCKET, "_start", "_low", "_high", "_net", "_safe", "_sum"])


def _prove_stock(rows: pd.DataFrame) -> pd.DataFrame:
    """Reads a ledger's buckets in order: the stock at their start as far as known, and which have to be folded again."""
    stock, out = 0, []
    for r in rows.sort_values(BUCKET).to_dict("records"):
        low, high = int(r["_low"]), r["_high"]
        known = low <= stock and (high is None or stock < int(high))
        all_count = stock >= int(r["_safe"])
        out.append((r["ledger"], r[BUCKET], Decimal(stock), not (known or all_count)))
        # a wrong start leads to the same stock in the end more often than not
        stock = stock + int(r["_net"]) if known else stock + int(r["_sum"]) if all_count else int(r["_start"]) + int(r["_net"])
    return pd.DataFrame(out, columns=["ledger", BUCKET, "_start", "_again"])


def _exact_stock(rows: DataFrame) -> DataFrame:
    """(ledger, bucket, _start): the stock in units at the start of every bucket, skipping sales without stock.

    Every bucket is folded from a guess, all in parallel, to its piece of the function from the stock
    before to the stock after it. The pieces are read in order, one row per bucket. A bucket whose true
    start is outside its piece is folded again from there. Two starts with different sales meet in
    the same stock sooner or later, so a bucket's end is mostly right even from a wrong guess: if
    buckets are long beside the time to meet (quantities in lots), two or three rounds do, else one
    more per bucket. Every round proves one bucket more at least.
    """
    keys, units = ["ledger", BUCKET], "decimal(38,0)"
    head = f"ledger {rows.schema['ledger'].dataType.simpleString()}, {BUCKET} int"
    todo = rows.select(*keys).distinct().withColumn("_start", F.lit(0).cast(units))
    pieces = None
    while True:
        new = rows.join(small(todo), keys).groupBy(*keys).applyInPandas(
            _stock_piece, f"{head}, " + ", ".join(f"{c} {units}" for c in ("_start", "_low", "_high", "_net", "_safe", "_sum")))
        pieces = stage(new if pieces is None else new.unionByName(pieces.join(small(todo.select(*keys)), keys, "left_anti")))
        proved = stage(pieces.groupBy("ledger").applyInPandas(_prove_stock, f"{head}, _start {units}, _again boolean"))
        todo = proved.where("_again").drop("_again")
        if todo.isEmpty():
            return proved.drop("_again")


def _cost_piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one bucket does to cost and result, from its exact stock."""
    start = stock = int(pdf["_start"].iloc[0])
    a, b, paid, got, bad = 1.0, 0.0, 0.0, 0.0, 0
    for buy, q, n, f in _walked(pdf):
        if buy:
            stock, b, paid = stock + q, b + n + f, paid + n + f
        elif stock < q:
            bad += 1
        else:
            keep = (stock - q) / stock if stock else 1.0
            stock, a, b, got = stock - q, a * keep, b * keep, got + n - f
    return pd.DataFrame([[pdf["ledger"].iloc[0], pdf[BUCKET].iloc[0], a, b, paid, got, (stock - start) / UNITS, bad]],
                        columns=["ledger", BUCKET, "a", "b", "_paid", "_got", "_dq", "_bad"])


def _short_cost(fills: DataFrame, parts: int | None) -> DataFrame:
    """Average cost of ledgers with sales that do not count, in parallel over their buckets."""
    rows = fills.select("ledger", "sequence", "side", "notional", "fee",
                        (F.col("qty").cast("decimal(28,10)") * F.lit(UNITS)).cast("decimal(38,0)").alias("_units"))
    if rows.isEmpty():
        return _chained(rows.limit(0).select("ledger", F.lit(0).alias(BUCKET), F.lit(0).cast("bigint").alias("_bad"), F.struct(
            F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).alias("_f"), *[F.lit(0.0).alias(x) for x in ("_paid", "_got", "_dq")]))
    rows = stage(bucketed(rows, ["sequence"], parts))
    starts = _exact_stock(rows)
    part = rows.join(small(starts), ["ledger", BUCKET]).groupBy("ledger", BUCKET).applyInPandas(
        _cost_piece, f"ledger {rows.schema['ledger'].dataType.simpleString()}, {BUCKET} int, a double, b double, _paid double, _got double, _dq double, _bad bigint")
    return _chained(part.withColumn("_f", F.struct("a", "b")))


def document_events(events: DataFrame) -> DataFrame:
    """Events of ledger documents under the names used here."""
    c = F.col
    return events.select(
        "ledger", "position", "sequence", "id", c("previousHash").alias("previous"), "hash", c("type").alias("kind"), "fill_id",
        F.coalesce("exchange", "from_exchange").alias("venue"), c("to_exchange").alias("to_venue"), "side", c("quantity_btc").alias("qty"),
        c("execution_price_usd").alias("price"), c("reference_price_usd").alias("reference"), c("fee_usd").alias("fee"), "btc", "usd", c("cost_usd").alias("cost"))


def audit_documents(docs: DataFrame, parts: int | None = None) -> dict[str, DataFrame]:
    """Audit of ledger documents: totals, result, errors.

    Links, sequences, duplicates and amounts are checked here. The events' own hashes cover the text
    of the amounts, which this parse does not keep: see :func:`document_hash_errors`.
    """
    from tapelab.sources.ledger import ledger_events

    ev = document_events(ledger_events(docs))
    heads = docs.select("ledger", F.col("eventCount").alias("event_count"), F.col("headHash").alias("head_hash"),
                        F.col("markPriceUsd").alias("mark"), F.col("reportedNetPnlUsd").alias("reported"))

    def balances(name):
        return docs.select("ledger", F.explode(name).alias("at", "b")).select("ledger", "at", "b.btc", "b.usd")

    initial, declared = balances("initialBalances"), balances("finalBalances")
    money = ev.select("*").withColumns({c: F.coalesce(F.col(c).cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)")) for c in ("qty", "price", "reference", "fee", "btc", "usd", "cost")})
    start = initial.withColumns({c: F.col(c).cast("decimal(38,10)") for c in ("btc", "usd")})
    ch = deltas(money).withColumns({c: F.col(c).cast("decimal(38,10)") for c in ("btc", "usd")})
    bal = running_balances(ch, start, parts)
    fin = final_balances(ch, start)
    decl = declared.withColumns({c: F.col(c).cast("decimal(38,10)") for c in ("btc", "usd")})
    res = result_check(fin.withColumns({c: F.col(c).cast("decimal(38,10)") for c in ("btc", "usd")}), start, decl, heads.withColumns({"mark": F.col("mark").cast("decimal(18,8)"), "reported": F.col("reported").cast("decimal(38,8)")}))
    rows = with_previous(ev, ["ledger"], ["position"], "hash", parts).drop("position").withColumn("position", F.col("sequence"))
    link = F.when(F.col("before").isNull(), F.lit(GENESIS)).otherwise(F.col("before"))
    broken = rows.where(~F.col("previous").eqNullSafe(link)).select("ledger", "id", F.lit("chain").alias("error"))
    seq = ev.where(F.col("sequence") != F.col("position") + 1).select("ledger", "id", F.lit("sequence").alias("error"))
    amounts = money.where(~usable_fill()).select("ledger", "id", F.lit("amount").alias("error"))
    errors = broken.unionByName(seq).unionByName(duplicates(ev, "id", "duplicate_id")).unionByName(duplicates(ev, "fill_id", "duplicate_fill"))
    errors = errors.unionByName(head_errors(ev, heads)).unionByName(amounts).unionByName(negative_balances(bal))
    bad = res.select("ledger", F.lit("").alias("id"), F.explode(F.array_compact(F.array(
        F.when(~F.col("balances_match"), F.lit("final_balances")), F.when(~F.col("result_matches"), F.lit("reported_result"))))).alias("error"))
    return {"totals": totals(money), "result": res, "errors": errors.unionByName(bad)}



def document_hash_errors(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """(ledger, id, error) of ledger documents read with ``read_ledger_texts``: hash, chain, head.

    ``hash``: an event's hash does not cover its own text. ``chain``: its previous hash is not that of the
    last event before it whose hash is right (GENESIS if there is none), so what follows a changed event
    is reported with it. ``head``: the declared head is not the last right hash.
    """
    from tapelab.sources.ledger import event_text, ledger_events

    ev = ledger_events(texts).withColumn("right", F.coalesce(F.sha2(event_text(), 256) == F.col("hash"), F.lit(False)))
    ev = ev.select("ledger", "position", "id", F.col("previousHash").alias("previous"), "hash", "right")
    good = F.when(F.col("right"), F.struct("position", "hash"))
    rows = running(ev.withColumn("_good", good), ["ledger"], ["position"], {"before": ("max", "_good")}, parts, exclusive=True)
    why = F.array_compact(F.array(
        F.when(~F.col("right"), F.lit("hash")), F.when(~F.col("previous").eqNullSafe(F.coalesce("before.hash", F.lit(GENESIS))), F.lit("chain"))))
    last = ev.groupBy("ledger").agg(F.max(good).alias("_last"))
    heads = texts.select("ledger", "headHash").join(last, "ledger", "left").where(~F.col("headHash").eqNullSafe(F.coalesce("_last.hash", F.lit(GENESIS))))
    return rows.select("ledger", "id", F.explode(why).alias("error")).unionByName(
        heads.select("ledger", F.lit("").alias("id"), F.lit("head").alias("error")))


def audit_ledger_files(spark, path, parts: int | None = None) -> dict[str, DataFrame]:
    """:func:`audit_documents` of the documents at ``path``, with the errors of their events' own hashes."""
    from tapelab.sources.ledger import read_ledger_texts, read_ledgers

    out = audit_documents(read_ledgers(spark, path), parts)
    hashes = document_hash_errors(read_ledger_texts(spark, path), parts)
    return out | {"errors": out["errors"].unionByName(hashes).distinct()}
