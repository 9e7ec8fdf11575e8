"""Routes, opportunities, decisions, selection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tapelab import bindings as B
from tapelab.catalog.base import query, r6, r9, s6, s9
from tapelab.catalog.scan import cost_sql
from tapelab.functions import costs as C
from tapelab.functions import quality as Q
from tapelab.operators import asof, book, funnel, routes

M = B.MODEL
# decisions compare the latency, not the quote age; legs without levels walk at no cost
D = replace(M, stale_ms=5000, slippage_fallback="zero")
COST = cost_sql("qty", "0.0::DOUBLE", "0.0::DOUBLE")


def latest(spark, sf):
    return asof.latest_by_venue(B.quotes(spark, sf), funnel.PAYLOAD)


def opps(spark, sf):
    return routes.detect("linear", latest(spark, sf), B.venues(spark), D, B.STALE_US)


_R = f"""WITH {B.QUOTES_SQL}, {B.asof_sql()},
routes AS (
 SELECT f.seq, f.pair, f.t, f.q.venue AS buy_venue, g.q.venue AS sell_venue, f.q.ask AS ask, g.q.bid AS bid, f.q.ask_qty AS buy_depth, g.q.bid_qty AS sell_depth,
  greatest(f.q.latency_ms, g.q.latency_ms) AS latency_ms, vb.fee AS buy_fee, vs.fee AS sell_fee, vb.withdrawal_btc AS buy_withdrawal, vs.withdrawal_btc AS sell_withdrawal,
  vb.usd_lane AS buy_usd_lane, vs.usd_lane AS sell_usd_lane
 FROM fresh f JOIN fresh g ON f.seq=g.seq AND f.q.venue<>g.q.venue AND g.q.bid>f.q.ask
 JOIN venues vb ON vb.venue=f.q.venue JOIN venues vs ON vs.venue=g.q.venue WHERE vb.usd_lane=vs.usd_lane),
z AS (SELECT *, least({M.max_btc}::DOUBLE, buy_depth, sell_depth, 100000.0::DOUBLE/(ask*(1.0::DOUBLE+buy_fee)), 10.0::DOUBLE) AS lim FROM routes),
sz AS (SELECT *, CASE WHEN lim<=0 THEN 0.0::DOUBLE ELSE lim END AS qty FROM z),
u AS (SELECT *, {COST["total"]} AS cost_total FROM sz),
u2 AS (SELECT *, (bid-ask)*qty - cost_total AS utility_usd FROM u),
u3 AS (SELECT *, CASE WHEN qty>0 THEN utility_usd/qty ELSE 0.0::DOUBLE END AS unit FROM u2),
u4 AS (SELECT *, unit/((ask+bid)/2.0::DOUBLE)*10000.0::DOUBLE AS net_bps, (bid-ask)/((ask+bid)/2.0::DOUBLE)*10000.0::DOUBLE AS gross_bps FROM u3),
opp AS (SELECT *, CASE WHEN qty<=0 THEN 'SKIP_THIN_OR_INVENTORY' WHEN utility_usd < {M.min_utility_usd}::DOUBLE THEN 'SKIP_MIN_USD'
  WHEN net_bps < {M.min_net_bps}::DOUBLE THEN 'SKIP_NET_BPS' WHEN latency_ms > 5000 THEN 'SKIP_STALE' ELSE 'ACCEPT_EXECUTABLE' END AS code,
  CASE WHEN qty<=0 THEN least({M.max_btc}::DOUBLE, buy_depth) WHEN utility_usd < {M.min_utility_usd}::DOUBLE THEN {M.min_utility_usd}::DOUBLE
  WHEN net_bps < {M.min_net_bps}::DOUBLE THEN {M.min_net_bps}::DOUBLE WHEN latency_ms > 5000 THEN 5000.0::DOUBLE ELSE {M.min_net_bps}::DOUBLE END AS threshold,
  qty>0 AND qty < {M.max_btc}::DOUBLE*0.999::DOUBLE AS partial FROM u4)"""


@query(f"{_R} SELECT seq, buy_venue, sell_venue, {s6('ask','ask')}, {s6('bid','bid')}, latency_ms FROM routes")
def route_join(spark, sf):
    r = routes.route_rows(latest(spark, sf), B.venues(spark), D, B.STALE_US)
    return r.select("seq", "buy_venue", "sell_venue", r6("ask", "ask"), r6("bid", "bid"), "latency_ms")


@query(f"{_R} SELECT seq, buy_venue, sell_venue, {s6('qty','qty')}, {s6('cost_total','cost_total')}, {s6('utility_usd','utility_usd')}, {s6('gross_bps','gross_bps')}, {s6('net_bps','net_bps')}, code, {s6('threshold','threshold')}, partial FROM opp")
def opportunities(spark, sf):
    o = opps(spark, sf)
    return o.select("seq", "buy_venue", "sell_venue", r6("qty", "qty"), r6("costs.total", "cost_total"), *[r6(c, c) for c in ("utility_usd", "gross_bps", "net_bps")],
                    F.col("decision.code").alias("code"), r6("decision.threshold", "threshold"), "partial")


@query(f"""{_R}, n AS (SELECT count(*) AS evaluated, count(*) FILTER (WHERE code='SKIP_STALE') AS stale, count(*) FILTER (WHERE code='SKIP_THIN_OR_INVENTORY') AS thin,
 count(*) FILTER (WHERE code='SKIP_MIN_USD') AS min_usd, count(*) FILTER (WHERE code='SKIP_NET_BPS') AS net_bps, count(*) FILTER (WHERE code='SKIP_CIRCUIT_BREAKER') AS breaker,
 count(*) FILTER (WHERE code='ACCEPT_EXECUTABLE') AS executable FROM (SELECT CASE WHEN code='ACCEPT_EXECUTABLE' AND t//3600000000 % 5 = 0 THEN 'SKIP_CIRCUIT_BREAKER' ELSE code END AS code FROM opp))
SELECT *, evaluated-stale AS fresh, evaluated-stale-thin AS liquid, evaluated-stale-thin-min_usd-net_bps AS cost_positive, evaluated-stale-thin-min_usd-net_bps-breaker AS risk_allowed FROM n""")
def decision_funnel(spark, sf):
    o = opps(spark, sf)
    tripped = F.floor(F.col("t") / 3_600_000_000) % 5 == 0
    return funnel.decision_funnel(o.withColumn("code", C.with_breaker("decision.code", tripped)))


@query(f"""{_R}, s AS (SELECT *, row_number() OVER (ORDER BY code='ACCEPT_EXECUTABLE' DESC, utility_usd DESC, buy_venue, sell_venue, t, seq) AS r FROM opp) SELECT seq, buy_venue, sell_venue, {s6('utility_usd','utility_usd')} FROM s WHERE r<=80""")
def ranked_opportunities(spark, sf):
    o = routes.rank_opportunities(opps(spark, sf), 80)
    return o.select("seq", "buy_venue", "sell_venue", r6("utility_usd", "utility_usd"))


@query(f"""{_R}, s AS (SELECT *, row_number() OVER (PARTITION BY t//3600000000 ORDER BY code='ACCEPT_EXECUTABLE' DESC, round(utility_usd,9) DESC, seq, buy_venue, sell_venue) AS position FROM opp)
SELECT t//3600000000 AS tick, position, seq, buy_venue, sell_venue, code FROM s WHERE position<=18""")
def top_decisions(spark, sf):
    o = opps(spark, sf).withColumn("tick", F.floor(F.col("t") / 3_600_000_000))
    out = routes.top_per_tick(o, ["tick"], [F.col("executable").desc(), F.round("utility_usd", 9).desc(), "seq", "buy_venue", "sell_venue"], 18)
    return out.select("tick", F.col("position").cast("bigint").alias("position"), "seq", "buy_venue", "sell_venue", F.col("decision.code").alias("code"))


@query(f"""{_R}, b AS (SELECT seq, buy_venue, sell_venue, (bid-ask)*qty AS gross, ({COST["fee_buy"]}) AS buy_fee_usd, ({COST["fee_sell"]}) AS sell_fee_usd, ({COST["slippage"]}) AS slippage_usd,
 ({COST["withdrawal"]}) AS rebalance_usd, ({COST["latency"]}) AS latency_usd, cost_total FROM opp)
SELECT seq, buy_venue, sell_venue, {", ".join(s9(x, x) for x in ("buy_fee_usd", "sell_fee_usd", "slippage_usd", "rebalance_usd", "latency_usd"))}, {s9('gross','gross_spread_usd')}, {s9('cost_total','total_cost_usd')}, {s9('cost_total*0.5::DOUBLE','half_cost_usd')} FROM b""")
def profit_breakdown(spark, sf):
    o = opps(spark, sf)
    b = o.select("seq", "buy_venue", "sell_venue", *C.profit_breakdown(), C.scale_costs("costs", F.lit(0.5)).alias("half"))
    names = ("buy_fee_usd", "sell_fee_usd", "slippage_usd", "rebalance_usd", "latency_usd", "gross_spread_usd", "total_cost_usd")
    return b.select("seq", "buy_venue", "sell_venue", *[r9(n, n) for n in names], r9("half.total", "half_cost_usd"))


# book-walk slippage over six levels: closed form of the walk
def _walk(side: str, qty: str) -> str:
    return f"""SELECT l.seq, sum(greatest(0.0::DOUBLE, least(l.qty, {qty} - l.before))*l.price) AS paid, sum(greatest(0.0::DOUBLE, least(l.qty, {qty} - l.before))) AS got,
 min(CASE WHEN lv=0 THEN l.price END) AS first FROM (SELECT *, coalesce(sum(qty) OVER (PARTITION BY seq ORDER BY lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {side}_levels) l GROUP BY l.seq"""


@query(f"""WITH {B.QUOTES_SQL}, {B.LEVELS_SQL}, b AS ({_walk('bid', '3.0::DOUBLE')}), a AS ({_walk('ask', '3.0::DOUBLE')}),
s AS (SELECT b.seq, ((a.paid + (3.0::DOUBLE-a.got)*a.first)/3.0::DOUBLE - a.first)*3.0::DOUBLE AS buy, -((b.paid + (3.0::DOUBLE-b.got)*b.first)/3.0::DOUBLE - b.first)*3.0::DOUBLE AS sell, a.first AS fa, b.first AS fb FROM b JOIN a USING (seq))
SELECT seq, round(least(greatest(buy,0.0::DOUBLE), 3.0::DOUBLE*fa*2.0::DOUBLE/10000.0::DOUBLE),6)+0.0 AS buy_slippage, round(least(greatest(sell,0.0::DOUBLE), 3.0::DOUBLE*fb*2.0::DOUBLE/10000.0::DOUBLE),6)+0.0 AS sell_slippage FROM s""")
def walk_slippage(spark, sf):
    q = B.quotes(spark, sf, levels=True)
    z = F.lit(0.0)
    buy = C.walk_slippage(F.lit(3.0), C.Leg(z, z, z, F.lit(False), F.col("asks")), True, M)
    sell = C.walk_slippage(F.lit(3.0), C.Leg(z, z, z, F.lit(False), F.col("bids")), False, M)
    return q.select("seq", r6(buy, "buy_slippage"), r6(sell, "sell_slippage"))


_TRI = """WITH q AS (SELECT event_type AS venue, epoch_us(ts)//14400000000 AS snap, user_id%3 AS p, event_id AS seq, value, event_id*37%6000 AS latency_ms FROM events),
l AS (SELECT venue, snap, p, arg_max(value, seq) AS v, arg_max(latency_ms, seq) AS lat FROM q GROUP BY ALL),
legs AS (SELECT a.venue, a.snap, 60000.0::DOUBLE + (cast(round(a.v*100) AS bigint)%50) AS p1, 0.05::DOUBLE + (cast(round(b.v*100) AS bigint)%7)/1000.0::DOUBLE AS p2,
 3000.0::DOUBLE + (cast(round(c.v*100) AS bigint)%400) AS p3, greatest(a.lat,b.lat,c.lat) AS latency_ms FROM l a JOIN l b ON a.venue=b.venue AND a.snap=b.snap AND a.p=0 AND b.p=1 JOIN l c ON a.venue=c.venue AND a.snap=c.snap AND c.p=2),
g AS (SELECT *, (1.0::DOUBLE/p1)*(1.0::DOUBLE/p2)*p3 - 1.0::DOUBLE AS gross, least(1.5::DOUBLE, 1000.0::DOUBLE/p1) AS qty, (p1+p2+p3)/3.0::DOUBLE AS mid FROM legs),
k AS (SELECT g.*, qty*p1*v.fee*3.0::DOUBLE + qty*mid*2.0::DOUBLE/10000.0::DOUBLE + qty*mid*0.02::DOUBLE/10000.0::DOUBLE AS cost_usd FROM g JOIN venues v USING (venue) WHERE gross>0 AND qty>0)
"""
_V = B.QUOTES_SQL[B.QUOTES_SQL.index("venues(venue"):]


@query(_TRI.replace("WITH q AS", f"WITH {_V}, q AS", 1) + f"SELECT venue, snap, {s6('gross','gross')}, {s6('qty','qty')}, {s6('cost_usd','cost_usd')}, {s6('gross*qty-cost_usd','utility_usd')}, latency_ms FROM k WHERE gross*qty-cost_usd >= -1.0::DOUBLE")
def triangular_routes(spark, sf):
    e = B.read(spark, sf, "events")
    p = F.col("user_id") % 3
    x = F.round(F.col("value") * 100).cast("bigint")
    q = e.select(F.col("event_type").alias("venue"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 14_400_000_000).alias("snap"), p.alias("p"),
                 F.struct(F.col("event_id").alias("seq"), x.alias("x"), (F.col("event_id") * 37 % 6000).alias("latency_ms")).alias("s"))
    q = q.groupBy("venue", "snap", "p").agg(F.max("s").alias("s")).select("venue", "snap", "p", "s.*")
    price = (F.when(F.col("p") == 0, 60000.0 + F.col("x") % 50).when(F.col("p") == 1, 0.05 + F.col("x") % 7 / 1000.0).otherwise(3000.0 + F.col("x") % 400))
    pair = F.when(F.col("p") == 0, "BTC/USD").when(F.col("p") == 1, "ETH/BTC").otherwise("ETH/USD")
    q = q.select("venue", "snap", pair.alias("pair"), price.alias("ask"), price.alias("bid"), "latency_ms")
    out = routes.detect("triangular", q, B.venues(spark), replace(M, min_utility_usd=-1.0), F.lit(1000.0), ["snap"])
    return out.select("venue", "snap", *[r6(c, c) for c in ("gross", "qty", "cost_usd", "utility_usd")], "latency_ms")


@query(f"""WITH {B.QUOTES_SQL}, p AS (SELECT seq, venue, pair, t + 3600000000 AS at FROM quotes)
SELECT p.seq, q.seq AS later_seq, q.bid_tick, q.ask_tick FROM p ASOF JOIN quotes q ON p.venue=q.venue AND p.pair=q.pair AND p.at >= q.t""")
def delayed_quote_asof(spark, sf):
    q = B.quotes(spark, sf)
    p = q.select(F.col("seq").alias("id"), "venue", "pair", (F.col("t") + 3_600_000_000).alias("t"))
    out = asof.asof_quotes(p, q, ["bid_tick", "ask_tick"], ["venue", "pair"])
    return out.select(F.col("id").alias("seq"), F.col("quote.seq").alias("later_seq"), "quote.bid_tick", "quote.ask_tick")


@query(f"""{_R}, p AS (SELECT *, t + 1800000000 AS due FROM opp WHERE code='ACCEPT_EXECUTABLE'),
b AS (SELECT p.*, q.t AS bt, q.ask AS nask, q.ask_qty AS nbd, q.latency_ms AS bl FROM p ASOF JOIN quotes q ON p.buy_venue=q.venue AND p.pair=q.pair AND p.due>=q.t),
s AS (SELECT b.*, q.t AS st, q.bid AS nbid, q.bid_qty AS nsd, q.latency_ms AS sl FROM b ASOF JOIN quotes q ON b.sell_venue=q.venue AND b.pair=q.pair AND b.due>=q.t),
n AS (SELECT seq, buy_venue, sell_venue, net_bps AS was, due-bt<={B.STALE_US} AND nbd>0 AS okb, due-st<={B.STALE_US} AND nsd>0 AS oks, nask AS ask, nbid AS bid, nbd AS buy_depth, nsd AS sell_depth,
 greatest(bl,sl) AS latency_ms, buy_fee, sell_fee, buy_withdrawal, sell_withdrawal, buy_usd_lane, sell_usd_lane FROM s),
nz AS (SELECT *, CASE WHEN least(buy_depth,sell_depth)<=0 THEN 0.0::DOUBLE ELSE least({M.max_btc}::DOUBLE, buy_depth, sell_depth, 100000.0::DOUBLE/(ask*(1.0::DOUBLE+buy_fee)), 10.0::DOUBLE) END AS qty FROM n),
nu AS (SELECT *, (bid-ask)*qty - {COST["total"]} AS u FROM nz),
nv AS (SELECT *, CASE WHEN qty>0 THEN u/qty ELSE 0.0::DOUBLE END/((ask+bid)/2.0::DOUBLE)*10000.0::DOUBLE AS nb FROM nu),
nw AS (SELECT *, NOT (qty<=0 OR u<{M.min_utility_usd}::DOUBLE OR nb<{M.min_net_bps}::DOUBLE OR latency_ms>5000) AS ex FROM nv)
SELECT CASE WHEN NOT okb OR NOT oks THEN 'revalidacion_fallida' WHEN NOT ex OR u<=0 OR was-nb > 2.0::DOUBLE THEN 'revalidacion_rechazada' ELSE 'accepted' END AS outcome, count(*) AS n FROM nw GROUP BY 1""")
def revalidation(spark, sf):
    o = opps(spark, sf).where("executable").select("seq", "pair", "t", "buy_venue", "sell_venue", "net_bps")
    q = B.quotes(spark, sf).select("venue", "pair", "t", "seq", "bid", "ask", "bid_qty", "ask_qty", "latency_ms")
    later = o.withColumn("t", F.col("t") + 1_800_000_000).withColumn("id", F.col("seq")).drop("seq")
    pay = ["bid", "ask", "bid_qty", "ask_qty", "latency_ms"]
    for side in ("buy", "sell"):
        p = later.withColumn("venue", F.col(f"{side}_venue"))
        later = asof.asof_quotes(p, q, pay, ["venue", "pair"]).withColumnRenamed("quote", f"_{side}").drop("venue", "seq")
    fresh = lambda s, size: (F.col("t") - F.col(f"_{s}.t") <= B.STALE_US) & (F.col(f"_{s}.{size}") > 0)
    later = later.withColumns({
        "now_buy": F.when(fresh("buy", "ask_qty"), F.col("_buy")), "now_sell": F.when(fresh("sell", "bid_qty"), F.col("_sell"))})
    rows = later.select("id", "net_bps", "now_buy", "now_sell", "buy_venue", "sell_venue", F.col("_buy.ask").alias("ask"), F.col("_sell.bid").alias("bid"),
                        F.col("_buy.ask_qty").alias("buy_depth"), F.col("_sell.bid_qty").alias("sell_depth"), F.greatest("_buy.latency_ms", "_sell.latency_ms").alias("latency_ms"))
    v = B.venues(spark)
    rows = funnel.with_venue_config(funnel.with_venue_config(rows, v, "buy_venue", "buy_"), v, "sell_venue", "sell_").withColumnRenamed("net_bps", "was")
    again = C.opportunity(rows, D, F.lit(100000.0), F.lit(10.0))
    again = again.select("now_buy", "now_sell", F.col("executable").alias("now_executable"), F.col("utility_usd").alias("now_utility"),
                         F.col("net_bps").alias("now_net_bps"), F.col("was").alias("net_bps"))
    return routes.revalidate(again, D).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT s_name AS venue, s_acctbal AS usd, cast(sum(cast(round(s_acctbal*100) AS bigint)) OVER (PARTITION BY s_nationkey) AS bigint)::DOUBLE/100.0::DOUBLE/count(*) OVER (PARTITION BY s_nationkey) AS target FROM supplier),
s AS (SELECT usd-target AS surplus, venue AS src, row_number() OVER (ORDER BY usd-target DESC, venue DESC) AS r FROM b),
l AS (SELECT * FROM b WHERE target>0 AND usd < target*(1.0::DOUBLE-0.35::DOUBLE))
SELECT l.venue, s.src AS source, {s6('least((l.target-l.usd)*0.5::DOUBLE, s.surplus)','amount')} FROM l JOIN s ON s.r = CASE WHEN (SELECT src FROM s WHERE r=1)<>l.venue THEN 1 ELSE 2 END WHERE s.surplus > 10.0::DOUBLE""")
def surplus_match(spark, sf):
    s = B.read(spark, sf, "supplier").withColumn("c", F.round(F.col("s_acctbal") * 100).cast("bigint"))
    mean = s.groupBy("s_nationkey").agg((F.sum("c").cast("double") / 100.0 / F.count("*")).alias("target"))
    b = s.join(mean, "s_nationkey").select(F.col("s_name").alias("venue"), F.col("s_acctbal").alias("usd"), "target")
    out = routes.surplus_match(b, "usd", "target", M, M.rebalance_cost_usd)
    return out.select("venue", "source", r6("amount", "amount"))


def _next(n: int, *chosen: str) -> str:
    """The best route per tick that shares no venue with those chosen."""
    free = "".join(f" AND NOT EXISTS (SELECT 1 FROM {c} c WHERE c.tick=b.tick AND (c.buy_venue=b.buy_venue OR c.sell_venue=b.sell_venue))" for c in chosen)
    return f"g{n} AS (SELECT * FROM b WHERE true{free} QUALIFY row_number() OVER (PARTITION BY tick ORDER BY score DESC, route)=1)"


@query(f"""WITH {B.TRADES_SQL}, b AS (SELECT t//86400000000 AS tick, route, buy_venue, sell_venue, max(pnl) AS score FROM trades WHERE pnl>0 GROUP BY ALL),
{_next(1)}, {_next(2, 'g1')}, {_next(3, 'g1', 'g2')}, {_next(4, 'g1', 'g2', 'g3')}
SELECT tick, route, buy_venue, sell_venue, score FROM (FROM g1 UNION ALL FROM g2 UNION ALL FROM g3 UNION ALL FROM g4)""")
def disjoint_batch(spark, sf):
    day = F.floor(F.col("t") / 86_400_000_000)
    t = B.trades(spark, sf).where("pnl > 0").select(day.alias("tick"), "route", "buy_venue", "sell_venue", F.col("pnl").alias("score"), "seq", "l_linenumber")
    return routes.disjoint_batch(t, ["tick"], "buy_venue", "sell_venue").select("tick", "route", "buy_venue", "sell_venue", "score")


@query(f"""WITH RECURSIVE {B.TRADES_SQL}, tm AS MATERIALIZED (SELECT DISTINCT route, t FROM trades), taken(route, t) AS (SELECT route, min(t) FROM tm GROUP BY route
 UNION ALL SELECT k.route, min(tm.t) FROM taken k JOIN tm ON tm.route=k.route AND tm.t >= k.t + {3 * 86_400_000_000} GROUP BY k.route) SELECT route, t FROM taken""")
def cooldown(spark, sf):
    return routes.cooldown(B.trades(spark, sf), ["route"], "t", 3 * 86_400_000_000)


# ---- books -----------------------------------------------------------------------------------
def messages(spark, sf):
    """Quotes as book messages: every eighth is a snapshot, the others replace or delete levels."""
    q = B.quotes(spark, sf, levels=True)
    s = F.col("seq")
    few = F.slice("bids", 1, 2), F.slice("asks", 1, 2)
    snap = s % 8 == 0
    q = q.withColumn("kind", F.when(snap, "snapshot").otherwise("delta"))
    return q.withColumn("bids", F.when(snap, F.col("bids")).otherwise(few[0])).withColumn(
        "asks", F.when(snap, F.col("asks")).otherwise(few[1])).select("venue", "pair", "t", "seq", "kind", "bids", "asks")


def _book_side(side: str, agg: str) -> str:
    return f"""{side}m AS (SELECT q.venue, q.pair, q.t, q.seq, l.lv, l.price, l.qty, q.seq%8=0 AS snap FROM quotes q JOIN {side}_levels l USING (seq) WHERE q.seq%8=0 OR l.lv<2),
{side}u AS (SELECT e.seq, m.price, arg_max(m.qty, (m.seq, m.lv)) AS qty FROM ev e JOIN {side}m m ON m.venue=e.venue AND m.pair=e.pair AND m.seq<=e.seq AND m.seq>=e.since GROUP BY e.seq, m.price),
{side}b AS (SELECT seq, {agg}(price) AS price, arg_{agg}(qty, price) AS qty, count(*) AS levels FROM {side}u WHERE qty<>0 GROUP BY seq)"""


@query(f"""WITH {B.QUOTES_SQL}, {B.LEVELS_SQL}, ev AS (SELECT *, coalesce(max(CASE WHEN seq%8=0 THEN seq END) OVER (PARTITION BY venue, pair ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS since FROM quotes),
{_book_side('bid','max')}, {_book_side('ask','min')}
SELECT e.seq, {s6('b.price','bid')}, {s6('b.qty','bid_qty')}, {s6('a.price','ask')}, {s6('a.qty','ask_qty')}, coalesce(b.levels,0) AS bid_levels, coalesce(a.levels,0) AS ask_levels FROM ev e LEFT JOIN bidb b USING (seq) LEFT JOIN askb a USING (seq)""")
def book_rebuild(spark, sf):
    b = book.rebuild_books(messages(spark, sf))
    return b.select("seq", *[r6(c, c) for c in ("bid", "bid_qty", "ask", "ask_qty")], F.size("bids").cast("bigint").alias("bid_levels"), F.size("asks").cast("bigint").alias("ask_levels"))


@query(f"""WITH {B.QUOTES_SQL}, {B.LEVELS_SQL}, b AS (SELECT seq, arg_min(price, lv) AS price, arg_min(qty, lv) AS qty, count(*) AS n FROM bid_levels WHERE qty<>0 GROUP BY seq),
a AS (SELECT seq, arg_min(price, lv) AS price, arg_min(qty, lv) AS qty, count(*) AS n FROM ask_levels WHERE qty<>0 GROUP BY seq)
SELECT q.seq, {s6('b.price','bid')}, {s6('b.qty','bid_qty')}, {s6('a.price','ask')}, {s6('a.qty','ask_qty')}, coalesce(b.n,0)+coalesce(a.n,0) AS levels FROM quotes q LEFT JOIN b USING (seq) LEFT JOIN a USING (seq)""")
def snapshot_books(spark, sf):
    q = B.quotes(spark, sf, levels=True).drop("bid", "ask", "bid_qty", "ask_qty")
    b = book.snapshot_books(q)
    return b.select("seq", *[r6(c, c) for c in ("bid", "bid_qty", "ask", "ask_qty")], (F.size("bids") + F.size("asks")).cast("bigint").alias("levels"))


def numbered(spark, sf):
    """Messages numbered per market with some numbers skipped, repeated or missing."""
    from tapelab.operators.ordered import ranked

    q = ranked(B.quotes(spark, sf).select("venue", "pair", "t", "seq"), ["venue", "pair"], ["t", "seq"])
    s, i = F.col("seq"), F.col("rank")
    num = i + F.when(s % 23 == 0, 5).when(s % 19 == 0, -2).otherwise(0)
    return q.withColumns({
        "kind": F.when(s % 11 == 0, "snapshot").otherwise("delta"), "sequence": F.when(s % 29 != 0, num), "previous": i - F.when(s % 31 == 0, 3).otherwise(1),
    }).drop("rank", "n")


_NUM = f"""WITH {B.QUOTES_SQL}, i AS (SELECT venue, pair, t, seq, row_number() OVER (PARTITION BY venue, pair ORDER BY t, seq)-1 AS i FROM quotes),
m AS (SELECT *, seq%11=0 AS snap, CASE WHEN seq%29<>0 THEN i + CASE WHEN seq%23=0 THEN 5 WHEN seq%19=0 THEN -2 ELSE 0 END END AS num, i - CASE WHEN seq%31=0 THEN 3 ELSE 1 END AS prev FROM i),
e AS (SELECT *, sum(snap::INT) OVER (PARTITION BY venue, pair ORDER BY i ROWS UNBOUNDED PRECEDING) AS epoch FROM m),
l AS (SELECT *, max(num) OVER (PARTITION BY venue, pair, epoch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)"""


def _seq_sql(gap: str, late: str, missing: str, good: str) -> str:
    return f"""{_NUM}, g AS (SELECT *, coalesce({gap}, false) AND NOT snap AND last IS NOT NULL AS gap FROM l),
b AS (SELECT *, coalesce(max(gap::INT) OVER (PARTITION BY venue, pair, epoch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=1 AS broken FROM g)
SELECT seq, CASE WHEN snap THEN 'snapshot' WHEN broken THEN 'esperando_snapshot' WHEN {missing} THEN 'secuencia_no_disponible' WHEN {late} THEN 'fuera_de_orden' WHEN gap THEN 'gap_requiere_snapshot' ELSE '{good}' END AS status FROM b"""


@query(_seq_sql("num > last+1", "num <= last", "num IS NULL", "secuencia_continua"))
def sequence_exact(spark, sf):
    return book.sequence_status(numbered(spark, sf), "exact").select("seq", "status")


@query(_seq_sql("false", "num < last", "num IS NULL", "secuencia_monotona"))
def sequence_monotone(spark, sf):
    return book.sequence_status(numbered(spark, sf), "monotone").select("seq", "status")


@query(_seq_sql("num IS NOT NULL AND (prev <> last OR num <= last)", "false", "num IS NULL OR prev IS NULL", "secuencia_enlazada"))
def sequence_linked(spark, sf):
    return book.sequence_status(numbered(spark, sf), "linked").select("seq", "status")


@query(f"""{_NUM}, o AS (SELECT *, t - CASE WHEN seq%17=0 THEN 40000000000 ELSE 0 END AS lt FROM m),
p AS (SELECT *, max(lt) OVER (PARTITION BY venue, pair ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt, max(num) OVER (PARTITION BY venue, pair ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn FROM o)
SELECT seq, 'time_order' AS failure FROM p WHERE lt<pt UNION ALL SELECT seq, 'sequence_order' FROM p WHERE NOT snap AND num<pn""")
def order_failures(spark, sf):
    n = numbered(spark, sf).withColumn("line", F.col("t"))
    n = n.withColumn("t", F.col("t") - F.when(F.col("seq") % 17 == 0, 40_000_000_000).otherwise(0)).withColumn("resync", F.col("kind") == "snapshot")
    return book.order_failures(n, ["line", "seq"]).select("seq", "failure")


def _ctext(x: str) -> str:
    return f"CASE WHEN ltrim(replace({x},'.',''),'0')='' THEN '0' ELSE ltrim(replace({x},'.',''),'0') END"


@query(f"""WITH {B.QUOTES_SQL}, d AS (SELECT seq, concat({_ctext("printf('%.2f', ask)")}, {_ctext("printf('%.1f', ask_qty)")}, {_ctext("printf('%.2f', bid)")}, {_ctext("printf('%.1f', bid_qty)")}) AS digits FROM quotes) SELECT seq, digits FROM d""")
def checksum_digits(spark, sf):
    q = B.quotes(spark, sf)
    parts = [Q.checksum_digits(F.format_string(f, F.col(c))) for f, c in (("%.2f", "ask"), ("%.1f", "ask_qty"), ("%.2f", "bid"), ("%.1f", "bid_qty"))]
    return q.select("seq", F.concat(*parts).alias("digits"))


def text_books(spark, sf):
    def text(levels):
        return F.transform(levels, lambda x: F.struct(F.format_string("%.2f", x["price"]).alias("price_text"), F.format_string("%.1f", x["qty"]).alias("qty_text")))

    return B.quotes(spark, sf, levels=True).withColumns({"bids": text("bids"), "asks": text("asks")})


@query()
def book_checksums(spark, sf):
    return text_books(spark, sf).select("seq", Q.book_checksum().alias("crc32"))


@query(f"""WITH {B.QUOTES_SQL} SELECT seq, CASE WHEN seq%5=0 THEN NULL WHEN seq%97=0 OR seq%89=0 THEN 'checksum_crc32_fallido_requiere_snapshot' ELSE 'checksum_crc32_ok' END AS status FROM quotes""")
def checksum_mismatches(spark, sf):
    """Books against the checksum stated when they were sent; in some a size changed or the best bid was lost on the way."""
    sent = text_books(spark, sf).withColumn("stated", F.when(F.col("seq") % 5 != 0, Q.book_checksum()))
    resized = F.transform("asks", lambda x, i: F.struct(x["price_text"].alias("price_text"), F.when(i == 0, F.concat(F.lit("1"), x["qty_text"])).otherwise(x["qty_text"]).alias("qty_text")))
    got = sent.withColumns({"asks": F.when(F.col("seq") % 97 == 0, resized).otherwise(F.col("asks")), "bids": F.when(F.col("seq") % 89 == 0, F.slice("bids", 2, 50)).otherwise(F.col("bids"))})
    return got.select("seq", Q.checksum_status("stated").alias("status"))


@query(f"""WITH {B.QUOTES_SQL}, {B.asof_sql(True, None)}, m AS (SELECT seq, max((q.bid+q.ask)/2.0::DOUBLE) AS hi, min((q.bid+q.ask)/2.0::DOUBLE) AS lo, count(*) AS k, min(q.t) AS oldest FROM fresh GROUP BY seq)
SELECT seq, {s6('(hi-lo)/((hi+lo)/2.0::DOUBLE)*10000.0::DOUBLE','spread_bps')} FROM m WHERE k>=2""")
def spread_series(spark, sf):
    out = asof.spread_series(asof.latest_by_venue(B.quotes(spark, sf), ["bid", "ask"]))
    return out.select("seq", r6("spread_bps", "spread_bps"))


@query(f"""WITH {B.QUOTES_SQL}, {B.asof_sql(False, None)} SELECT seq, max(t) - min(q.t) AS async_us FROM fresh GROUP BY seq""")
def venue_asynchrony(spark, sf):
    out = asof.latest_by_venue(B.quotes(spark, sf), ["bid"], by=[])
    return out.select("seq", asof.asynchrony().alias("async_us"))


@query(f"""WITH {B.QUOTES_SQL}, l AS (SELECT venue, arg_max(bid_tick+ask_tick, (t,seq)) AS s, max(t) AS t FROM quotes GROUP BY venue) SELECT count(*) AS venues, {s6('coalesce(sum(s)::DOUBLE/2.0::DOUBLE/count(*), 100000)','reference_tick')} FROM l""")
def reference_price(spark, sf):
    q = B.quotes(spark, sf).groupBy("venue").agg(F.max(F.struct("t", "seq", (F.col("bid_tick") + F.col("ask_tick")).alias("s"))).alias("q"))
    return q.agg(F.count("*").alias("venues"), r6(F.coalesce(F.avg(F.col("q.s") / 2.0), F.lit(100000.0)), "reference_tick"))


@query(f"""WITH {B.QUOTES_SQL}, g AS (SELECT venue, pair, t, lead(t) OVER (PARTITION BY venue, pair ORDER BY t, seq) AS nxt FROM quotes) SELECT venue, pair, t AS last_seen, nxt - t AS silent_us FROM g WHERE nxt - t > {B.STALE_US}""")
def feed_gaps(spark, sf):
    from tapelab.operators.latency import feed_gaps as f

    return f(B.quotes(spark, sf), B.STALE_US)


