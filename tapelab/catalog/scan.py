"""Scan funnel, quote quality, coverage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tapelab import bindings as B
from tapelab.catalog.base import query, r6, s6, wilson_sql
from tapelab.functions import quality as Q
from tapelab.functions.numeric import duration_ms, wilson
from tapelab.operators import asof, funnel

M = B.MODEL  # legs without levels cost qty * fee * 1000
S = replace(M, slippage_fallback="zero")  # the scan keeps no levels; here they cost nothing


def cost_sql(qty: str, slip_buy: str | None = None, slip_sell: str | None = None, model=M) -> dict[str, str]:
    """SQL of the cost items for columns ask, bid, buy_*, sell_*, latency_ms."""
    mid = "((ask + bid)/2.0::DOUBLE)"
    vol = max(model.max_btc * 20.0, 1.0)
    slip = f"(({slip_buy or f'({qty})*buy_fee*1000.0::DOUBLE'}) + ({slip_sell or f'({qty})*sell_fee*1000.0::DOUBLE'}))"
    wd = f"(({qty})*{mid}*{model.withdrawal_bps}::DOUBLE/10000.0::DOUBLE + {mid}*(buy_withdrawal+sell_withdrawal)*({qty})/{vol}::DOUBLE)"
    out = f"(CASE WHEN buy_usd_lane<>sell_usd_lane THEN {wd} + ({qty})*{mid}*{model.usdt_premium_bps}::DOUBLE/10000.0::DOUBLE ELSE {wd} END)"
    late = f"(({qty})*{mid}*{model.latency_bps}::DOUBLE*greatest(latency_ms,1)::DOUBLE/10000.0::DOUBLE/100.0::DOUBLE)"
    fb, fs = f"(({qty})*ask*buy_fee)", f"(({qty})*bid*sell_fee)"
    items = {"fee_buy": fb, "fee_sell": fs, "slippage": slip, "withdrawal": out, "latency": late}
    items["total"] = f"({fb}+{fs}+{slip}+{out}+{late})"
    return {k: f"(CASE WHEN ({qty})>0 THEN {v} ELSE 0.0::DOUBLE END)" for k, v in items.items()}


def cands_sql(by_pair: bool = True, stale=B.STALE_US, slip: str | None = "0.0::DOUBLE") -> str:
    cost = cost_sql("qty", slip, slip)
    return f"""WITH {B.QUOTES_SQL}, {B.asof_sql(by_pair, stale)},
legs AS (
  SELECT b.venue, b.pair, b.t, b.seq, b.bid AS quote_bid, b.ask AS quote_ask, buy.venue AS buy_venue,
         sell.venue AS sell_venue, buy.ask AS ask, sell.bid AS bid,
         greatest(least(buy.ask_qty, sell.bid_qty), 0.0::DOUBLE) AS available,
         greatest(buy.latency_ms, sell.latency_ms) AS latency_ms,
         vb.fee AS buy_fee, vb.withdrawal_btc AS buy_withdrawal, vb.usd_lane AS buy_usd_lane,
         vs.fee AS sell_fee, vs.withdrawal_btc AS sell_withdrawal, vs.usd_lane AS sell_usd_lane
  FROM best b JOIN venues vb ON vb.venue = b.buy.venue LEFT JOIN venues vs ON vs.venue = b.sell.venue),
sized AS (SELECT *, CASE WHEN sell_venue IS NULL THEN NULL ELSE least(available, {M.max_btc}::DOUBLE) END AS qty FROM legs),
cands AS (
  SELECT *, (bid-ask)/((ask+bid)/2.0::DOUBLE)*10000.0::DOUBLE AS gross_bps,
         {cost["total"]} AS cost_total,
         CASE WHEN ask*qty > 0 THEN {cost["total"]}/(ask*qty)*10000.0::DOUBLE ELSE 0.0::DOUBLE END AS cost_bps,
         ((quote_bid+quote_ask)/2.0::DOUBLE - (ask+bid)/2.0::DOUBLE)/((ask+bid)/2.0::DOUBLE)*10000.0::DOUBLE AS realized_bps
  FROM sized)"""


NET = "ask*qty > 0 AND gross_bps > cost_bps"
_funnel_cols = f"""count(*) AS events, count(sell_venue) AS comparable,
  count(*) FILTER (WHERE gross_bps > 0) AS gross, count(*) FILTER (WHERE gross_bps > 0 AND {NET}) AS net,
  count(*) FILTER (WHERE gross_bps > 0 AND {NET} AND available > 0) AS liquid_net"""


def _bounds() -> str:
    out = []
    for n in ("gross", "net", "liquid_net"):
        w = wilson_sql(n, "events")
        out += [s6(f"{n}::DOUBLE/greatest(events,1)::DOUBLE*1000000.0::DOUBLE", f"{n}_per_million"),
                s6(w["lower"], f"{n}_lower_95"), s6(w["upper"], f"{n}_upper_95")]
    return ", ".join(out)


def scan_candidates(spark, sf, model=S):
    return funnel.candidates(B.quotes(spark, sf), B.venues(spark), model, B.STALE_US)


def _rounded(df, names):
    return df.select(*[c for c in df.columns if c not in names], *[r6(c, c) for c in names])


@query(f"{cands_sql()}, f AS (SELECT {_funnel_cols} FROM cands) SELECT events, comparable, gross, net, liquid_net, {_bounds()} FROM f")
def corpus_scan_funnel(spark, sf):
    out = funnel.scan_funnel(scan_candidates(spark, sf))
    return _rounded(out, [c for c in out.columns if c.endswith(("million", "95"))])


@query(f"{cands_sql()} SELECT venue, pair, {_funnel_cols} FROM cands GROUP BY ROLLUP (venue, pair)")
def corpus_scan_rollup(spark, sf):
    return funnel.scan_rollup(scan_candidates(spark, sf))


@query(f"""{cands_sql(slip=None)} SELECT seq, buy_venue, sell_venue, latency_ms, {s6('ask', 'ask')}, {s6('bid', 'bid')},
 {s6('available', 'available')}, {s6('gross_bps', 'gross_bps')}, {s6('cost_bps', 'cost_bps')} FROM cands WHERE sell_venue IS NOT NULL""")
def best_pair_bounded(spark, sf):
    c = scan_candidates(spark, sf, M).where("sell_venue IS NOT NULL")
    return c.select("seq", "buy_venue", "sell_venue", "latency_ms", *[r6(x, x) for x in ("ask", "bid", "available", "gross_bps", "cost_bps")])


@query(f"""{cands_sql(False, None)} SELECT seq, buy_venue, sell_venue, {s6('gross_bps', 'gross_bps')},
 {s6('cost_bps', 'cost_bps')}, {s6('realized_bps', 'realized_bps')} FROM cands WHERE sell_venue IS NOT NULL""")
def best_pair_unbounded(spark, sf):
    c = funnel.candidates(B.quotes(spark, sf), B.venues(spark), S, None, by=[]).where("sell_venue IS NOT NULL")
    return c.select("seq", "buy_venue", "sell_venue", *[r6(x, x) for x in ("gross_bps", "cost_bps", "realized_bps")])


@query(f"""WITH {B.QUOTES_SQL}, {B.asof_sql()} SELECT CASE WHEN bid >= ask THEN 'bbo_invalido' ELSE 'sin_segundo_venue' END AS cause,
 count(*) AS events FROM best WHERE bid >= ask OR sell IS NULL GROUP BY 1""")
def corpus_scan_rejects(spark, sf):
    rows = asof.best_pair(asof.latest_by_venue(B.quotes(spark, sf), funnel.PAYLOAD), B.STALE_US)
    return funnel.scan_rejects(rows)


# a variant of the quotes with damaged rows, so that every cause occurs
_DAMAGED = """damaged AS (SELECT CASE WHEN seq % 97 = 0 THEN ' ' ELSE venue END AS venue, pair, t, seq,
  CASE WHEN seq % 89 = 0 THEN 'nan'::DOUBLE ELSE bid END AS bid, CASE WHEN seq % 83 = 0 THEN bid - 1.0::DOUBLE ELSE ask END AS ask,
  CASE WHEN seq % 79 = 0 THEN -bid_qty - 1.0::DOUBLE ELSE bid_qty END AS bid_qty, ask_qty, latency_ms FROM quotes)"""
_CAUSE = """CASE WHEN trim(venue)='' OR trim(pair)='' THEN 'identidad_vacia' WHEN isnan(bid) OR isnan(ask) THEN 'precio_no_finito'
  WHEN bid<=0 OR ask<=0 OR bid>=ask THEN 'bbo_invalido' WHEN bid_qty<0 OR ask_qty<0 THEN 'cantidad_invalida' ELSE 'valid' END"""


def damaged(spark, sf):
    s = F.col("seq")
    return B.quotes(spark, sf).withColumns({
        "venue": F.when(s % 97 == 0, " ").otherwise(F.col("venue")),
        "bid": F.when(s % 89 == 0, F.lit(float("nan"))).otherwise(F.col("bid")),
        "ask": F.when(s % 83 == 0, F.col("bid") - 1.0).otherwise(F.col("ask")),
        "bid_qty": F.when(s % 79 == 0, -F.col("bid_qty") - 1.0).otherwise(F.col("bid_qty")),
    })


@query(f"WITH {B.QUOTES_SQL}, {_DAMAGED}, c AS (SELECT {_CAUSE} AS cause FROM damaged) SELECT cause, count(*) AS quotes FROM c WHERE cause<>'valid' GROUP BY cause")
def invalid_quotes_by_cause(spark, sf):
    return funnel.invalid_by_cause(damaged(spark, sf))


@query(f"""{cands_sql(False, None)}, {_DAMAGED}, c AS (SELECT {_CAUSE} AS cause FROM damaged),
q AS (SELECT count(*) AS raw_quotes, count(*) FILTER (WHERE cause='valid') AS valid_quotes FROM c),
e AS (SELECT count(*) AS comparable, count(*) FILTER (WHERE gross_bps>0) AS gross, count(*) FILTER (WHERE gross_bps-cost_bps>0) AS net,
 count(*) FILTER (WHERE gross_bps-cost_bps>0 AND available>0) AS liquid_net FROM cands WHERE sell_venue IS NOT NULL)
SELECT raw_quotes, valid_quotes, comparable, gross, net, liquid_net,
 {s6('gross::DOUBLE/greatest(raw_quotes,1)::DOUBLE*1000000.0::DOUBLE', 'gross_per_million')},
 {s6('net::DOUBLE/greatest(raw_quotes,1)::DOUBLE*1000000.0::DOUBLE', 'net_per_million')},
 {s6('liquid_net::DOUBLE/greatest(raw_quotes,1)::DOUBLE*1000000.0::DOUBLE', 'liquid_net_per_million')} FROM q, e""")
def quantitative_funnel(spark, sf):
    c = funnel.candidates(B.quotes(spark, sf), B.venues(spark), S, None, by=[]).where("sell_venue IS NOT NULL")
    out = funnel.quote_funnel(damaged(spark, sf), c)
    return _rounded(out, [x for x in out.columns if x.endswith("million")])


@query(f"""WITH {B.QUOTES_SQL}, {_DAMAGED} SELECT seq FROM damaged WHERE venue<>'' AND NOT isnan(bid) AND NOT isnan(ask) AND bid>0 AND ask>0 AND bid<ask""")
def simple_valid_quotes(spark, sf):
    return damaged(spark, sf).where(Q.valid_bbo()).select("seq")


_DEPTHS = f"""bd AS (SELECT seq, coalesce(sum(qty) FILTER (WHERE qty>0),0) AS d FROM bid_levels GROUP BY seq),
ad AS (SELECT seq, coalesce(sum(qty) FILTER (WHERE qty>0),0) AS d FROM ask_levels GROUP BY seq)"""


@query(f"""WITH {B.QUOTES_SQL}, {B.LEVELS_SQL}, {_DEPTHS} SELECT q.seq, {s6('bd.d', 'bid_depth')}, {s6('ad.d', 'ask_depth')}
FROM quotes q JOIN bd ON q.seq=bd.seq JOIN ad ON q.seq=ad.seq""")
def visible_depth(spark, sf):
    q = B.quotes(spark, sf, levels=True)
    return q.select("seq", r6(Q.depth("bids", "bid_qty"), "bid_depth"), r6(Q.depth("asks", "ask_qty"), "ask_depth"))


@query(f"""WITH {B.QUOTES_SQL}, {_DAMAGED}, lim AS (SELECT max(t) AS m FROM quotes) SELECT seq FROM damaged, lim
WHERE venue<>'' AND NOT isnan(bid) AND bid>0 AND ask>0 AND bid<ask AND bid_qty>0 AND ask_qty>0 AND (m - t)//1000 <= 864000000""")
def valid_quotes(spark, sf):
    q = damaged(spark, sf)
    top = q.agg(F.max("t").alias("_m"))
    none = F.array().cast("array<struct<price:double,qty:double>>")
    q = q.join(F.broadcast(top)).withColumn("age", F.floor((F.col("_m") - F.col("t")) / 1000))
    return q.where(Q.valid_quote(Q.depth(none, "bid_qty"), Q.depth(none, "ask_qty"), "age", 864_000_000)).select("seq")


@query(f"""WITH {B.QUOTES_SQL} SELECT seq, cast(round(bid*100000000.0::DOUBLE) AS bigint) AS bid_key,
 cast(round(ask*100000000.0::DOUBLE) AS bigint) AS ask_key, ask_lot=0 AS deletes FROM quotes""")
def price_keys(spark, sf):
    return B.quotes(spark, sf).select(
        "seq", Q.price_key("bid").alias("bid_key"), Q.price_key("ask").alias("ask_key"), (F.col("ask_qty") == 0).alias("deletes"))


@query(f"""WITH {B.QUOTES_SQL}, {B.LEVELS_SQL}, d AS (
 SELECT seq, lv, 'b' AS side, CASE WHEN seq % 7 = 0 AND lv = 3 THEN 200.0::DOUBLE ELSE price END AS price,
   CASE WHEN seq % 11 = 0 AND lv = 2 THEN -1.0::DOUBLE ELSE qty END AS qty FROM bid_levels
 UNION ALL SELECT seq, lv, 'a', CASE WHEN seq % 5 = 0 AND lv = 4 THEN 1.0::DOUBLE ELSE price END, qty FROM ask_levels),
l AS (SELECT *, lag(price) OVER (PARTITION BY seq, side ORDER BY lv) AS before FROM d),
v AS (SELECT seq, CASE WHEN qty<0 OR price<=0 THEN 'bad_level' END AS a, CASE WHEN side='b' AND before<price THEN 'bids_unsorted' END AS b,
 CASE WHEN side='a' AND before>price THEN 'asks_unsorted' END AS c FROM l),
u AS (SELECT DISTINCT seq, a AS rule FROM v UNION SELECT seq, b FROM v UNION SELECT seq, c FROM v)
SELECT rule, count(*) AS messages FROM u WHERE rule IS NOT NULL GROUP BY rule""")
def level_violations(spark, sf):
    q = B.quotes(spark, sf, levels=True)
    s = F.col("seq")

    def damage(levels, cond, i, field, value):
        return F.transform(levels, lambda x, k: F.when(cond & (k == i), x.withField(field, F.lit(value))).otherwise(x))

    q = q.withColumn("bids", damage("bids", s % 7 == 0, 3, "price", 200.0))
    q = q.withColumn("bids", damage("bids", s % 11 == 0, 2, "qty", -1.0))
    q = q.withColumn("asks", damage("asks", s % 5 == 0, 4, "price", 1.0))
    bad = q.select("seq", F.explode(Q.level_violations()).alias("rule"))
    return bad.groupBy("rule").agg(F.count("*").alias("messages"))


@query("""SELECT c_mktsegment AS raw, CASE WHEN regexp_matches(c, 'USDT?$') THEN concat(regexp_replace(c, 'USDT?$', ''), '/USD') ELSE upper(p) END AS pair,
 count(*) AS n FROM (SELECT c_mktsegment, p, replace(replace(upper(trim(p)), '/', ''), '-', '') AS c FROM (
  SELECT c_mktsegment, concat(' ', lower(substr(c_mktsegment,1,3)), CASE WHEN c_custkey%3=0 THEN '-usdt' WHEN c_custkey%3=1 THEN '/USD' ELSE '/btc' END) AS p FROM customer))
GROUP BY ALL""")
def normalised_pairs(spark, sf):
    k = F.col("c_custkey") % 3
    tail = F.when(k == 0, "-usdt").when(k == 1, "/USD").otherwise("/btc")
    p = F.concat(F.lit(" "), F.lower(F.substring("c_mktsegment", 1, 3)), tail)
    df = B.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("raw"), Q.normal_pair(p).alias("pair"))
    return df.groupBy("raw", "pair").agg(F.count("*").alias("n"))


@query(f"WITH {B.QUOTES_SQL} SELECT CASE WHEN usd_lane THEN 'USD' ELSE 'USDT' END AS lane, count(*) AS quotes FROM quotes JOIN venues USING (venue) GROUP BY 1")
def quote_lanes(spark, sf):
    q = funnel.with_venue_config(B.quotes(spark, sf), B.venues(spark), "venue")
    return q.groupBy(Q.lane("usd_lane").alias("lane")).agg(F.count("*").alias("quotes"))


@query("""SELECT l_suppkey AS venue, count(*) AS trades, coalesce(max(s_acctbal)/1000000.0::DOUBLE, 0.0015::DOUBLE) AS fee,
 CASE WHEN max(s_suppkey) IS NULL THEN 0.90::DOUBLE ELSE 0.97::DOUBLE END AS reliability
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey%2=0) ON l_suppkey=s_suppkey GROUP BY l_suppkey""")
def venue_config_lookup(spark, sf):
    s = B.read(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(
        F.col("s_suppkey").alias("venue"), (F.col("s_acctbal") / 1000000.0).alias("fee"), F.lit(0.0001).alias("withdrawal_btc"),
        F.lit(0.97).alias("reliability"), F.lit(False).alias("usd_lane"))
    # trades are counted per venue first, so the lookup joins one row per venue, not per trade
    n = B.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("venue")).agg(F.count("*").alias("trades"))
    out = funnel.join_venue_config(n, s, "venue")
    return out.select("venue", "trades", "fee", "reliability")


@query(f"""WITH {B.QUOTES_SQL}, lim AS (SELECT max(t) AS m FROM quotes), l AS (
 SELECT venue, pair, max(t) AS t, arg_max(latency_ms > 4000, (t, seq)) AS rest FROM quotes GROUP BY venue, pair),
f AS (SELECT *, m - t <= 7200000000 AS fresh FROM l, lim), k AS (SELECT pair, count(*) AS k FROM f WHERE fresh GROUP BY pair)
SELECT (SELECT count(*) FROM venues) AS configured, count(DISTINCT venue) AS active, count(DISTINCT venue) FILTER (WHERE fresh) AS fresh,
 count(DISTINCT venue) FILTER (WHERE fresh AND NOT rest) AS fresh_socket, count(DISTINCT venue) FILTER (WHERE fresh AND rest) AS fresh_fallback,
 count(DISTINCT venue) FILTER (WHERE fresh AND k>=2) AS routable FROM f LEFT JOIN k USING (pair)""")
def venue_coverage(spark, sf):
    q = B.quotes(spark, sf).withColumn("rest", F.col("latency_ms") > 4000)
    now = F.lit(q.agg(F.max("t")).first()[0])
    return funnel.venue_coverage(q, B.venues(spark), now, 7_200_000_000)


@query(f"""WITH {B.QUOTES_SQL}, h AS (SELECT venue, latency_ms::DOUBLE/100.0::DOUBLE AS ms FROM quotes), b(le, bound) AS (VALUES
 ('0.1',0.1::DOUBLE),('0.5',0.5),('1.0',1.0),('2.5',2.5),('5.0',5.0),('10.0',10.0),('25.0',25.0),('50.0',50.0),('100.0',100.0),('500.0',500.0),('+Inf','inf'::DOUBLE))
SELECT venue, le, count(*) FILTER (WHERE ms<=bound) AS observations, count(*) AS total, {s6('sum(ms)', 'sum_ms')} FROM h, b GROUP BY venue, le""")
def latency_histogram(spark, sf):
    q = B.quotes(spark, sf).select("venue", (F.col("latency_ms") / 100.0).alias("ms"))
    return funnel.histogram(q, "venue", "ms").select("venue", "le", "observations", "total", r6("sum_ms", "sum_ms"))


_w = wilson_sql("k", "n", "1.959963984540054")


@query(f"WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE lang='en') AS k FROM documents GROUP BY source) SELECT source, n, k, {s6(_w['rate'],'rate')}, {s6(_w['lower'],'lower')}, {s6(_w['upper'],'upper')} FROM c")
def wilson_rates(spark, sf):
    d = B.read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("k"))
    w = wilson("k", "n", 1.959963984540054)
    return d.select("source", "n", "k", *[r6(w[x], x) for x in ("rate", "lower", "upper")])


@query("SELECT l_linenumber AS n, (l_linenumber * CASE WHEN l_linestatus='O' THEN 3600000 ELSE 60000 END)::BIGINT AS ms, count(*) AS k FROM lineitem GROUP BY ALL")
def duration_texts(spark, sf):
    unit = F.when(F.col("l_linestatus") == "O", "h").otherwise("m")
    df = B.read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("n"), F.concat(F.col("l_linenumber").cast("string"), unit).alias("text"))
    return df.groupBy("n", duration_ms("text").alias("ms")).agg(F.count("*").alias("k"))
