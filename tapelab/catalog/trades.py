"""Risk measures, drawdowns, rolling signals, quantiles, retention over the trade log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab import bindings as B
from tapelab.catalog.base import query, r6, s6
from tapelab.functions import edge as E
from tapelab.functions import quality as Q
from tapelab.functions import scoring
from tapelab.operators import risk, routes
from tapelab.operators.ordered import drawdown, ewma, newest, rank_percentiles, ranked, rolling_rows, rolling_sums, rolling_time
from tapelab.operators.retention import keep_days, last_minutes, latest_batch
from tapelab.session import stage

T, O, OSQL = f"WITH {B.TRADES_SQL}", B.TRADE_ORDER, B.TRADE_ORDER_SQL
DAY = 86_400_000_000

_ret = "CASE WHEN capital>0 THEN pnl::DOUBLE/capital::DOUBLE END"
_RATIOS = f"""count(*) AS trades, coalesce(sum(pnl),0)::BIGINT AS total_pnl,
 {s6(f"CASE WHEN count({_ret})<2 OR stddev_samp({_ret})=0 THEN 0 ELSE avg({_ret})/stddev_samp({_ret}) END", "sharpe")},
 {s6(f"CASE WHEN count({_ret})<2 OR avg(CASE WHEN pnl<0 THEN ({_ret})*({_ret}) ELSE 0 END)=0 THEN 0 ELSE avg({_ret})/sqrt(avg(CASE WHEN pnl<0 THEN ({_ret})*({_ret}) ELSE 0 END)) END", "sortino")},
 {s6('''CASE WHEN count(*) FILTER (WHERE pnl>0)=0 THEN 0 WHEN count(*) FILTER (WHERE pnl>0)=count(*) THEN 1
  WHEN avg(-pnl) FILTER (WHERE pnl<=0)<=0 THEN 1 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, count(*) FILTER (WHERE pnl>0)/count(*)
  - (1-count(*) FILTER (WHERE pnl>0)/count(*))/(avg(pnl) FILTER (WHERE pnl>0)/avg(-pnl) FILTER (WHERE pnl<=0)))) END''', "kelly")},
 {s6("(1+count(*) FILTER (WHERE pnl>0))/(2+count(*))", "win_probability")},
 {s6("count(*) FILTER (WHERE pnl>0)/greatest(count(*),1)", "win_rate")},
 {s6("count(*) FILTER (WHERE pnl>=1000000)/greatest(count(*),1)", "captured")}"""
_RN = ("sharpe", "sortino", "kelly", "win_probability", "win_rate", "captured")


def _ratios(df):
    return df.select(*[c for c in df.columns if c not in _RN], *[r6(c, c) for c in _RN])


@query(f"{T} SELECT route, {_RATIOS} FROM trades GROUP BY route")
def risk_by_route(spark, sf):
    return _ratios(risk.risk_summary(B.trades(spark, sf), ["route"], min_utility=1_000_000))


@query(f"{T} SELECT {_RATIOS} FROM trades")
def risk_total(spark, sf):
    return _ratios(risk.risk_summary(B.trades(spark, sf), [], min_utility=1_000_000))


@query(f"{T} SELECT count(*) AS rows, coalesce(sum(pnl),0)::BIGINT AS total_pnl, {s6('count(*) FILTER (WHERE pnl>0)/greatest(count(*),1)', 'win_rate')}, max(t) AS latest FROM trades")
def audit_summary(spark, sf):
    out = risk.latest_summary(B.trades(spark, sf), "pnl", ["t"])
    return out.select("rows", "total_pnl", r6("win_rate", "win_rate"), "latest")


def _dd_sql(part: str, key: str) -> str:
    w = f"OVER ({part} ORDER BY {OSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w2 = f"OVER ({part} ORDER BY {OSQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{T}, a AS (SELECT *, sum(pnl) {w} AS c FROM trades), b AS (SELECT *, greatest(max(c) {w2}, 0) AS peak FROM a)
 SELECT {key} sum(pnl)::BIGINT AS pnl, greatest(max(peak-c),0)::BIGINT AS max_drawdown FROM b"""


@query(_dd_sql("PARTITION BY route", "route,") + " GROUP BY route")
def drawdown_by_route(spark, sf):
    return drawdown(B.trades(spark, sf), ["route"], O, "pnl")


@query(_dd_sql("", ""))
def drawdown_total(spark, sf):
    return drawdown(B.trades(spark, sf), [], O, "pnl")


@query(f"""{T} SELECT {OSQL}, sum(pnl) OVER (PARTITION BY route ORDER BY {OSQL} ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative FROM trades""")
def cumulative_pnl(spark, sf):
    return risk.cumulative_pnl(B.trades(spark, sf), ["route"], O, "pnl").select(*O, "cumulative")


# z-score of the edge; exact integer sums in SQL
_Z = f"""{T}, e AS (SELECT *, pnl // capital AS edge FROM trades),
w AS (SELECT *, count(*) OVER f AS k, sum(edge) OVER f AS s, sum(edge*edge) OVER f AS q FROM e
 WINDOW f AS (PARTITION BY route ORDER BY {OSQL} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))"""
_ZV = "CASE WHEN k<15 OR k*q-s*s=0 THEN 0 ELSE (edge - s::DOUBLE/k::DOUBLE)/(sqrt((k*q-s*s)::DOUBLE)/k::DOUBLE) END"


def with_zscore(df, keys=("route",), value="edge"):
    v = F.col(value) if isinstance(value, str) else value
    out = rolling_sums(df, list(keys), O, {"_k": v.isNotNull().cast("bigint"), "_s": v, "_q": v * v}, 100)
    k, s = F.col("_k"), F.col("_s")
    spread = k * F.col("_q") - s * s  # k² times the variance, a whole number
    z = F.when((k < 15) | (spread == 0), 0.0).otherwise((v - s / k) / (F.sqrt(spread.cast("double")) / k))
    return out.withColumn("z", z).drop("_k", "_s", "_q", "rank", "n")


@query(f"{_Z} SELECT {OSQL}, route, {s6(_ZV, 'z')} FROM w")
def rolling_zscore(spark, sf):
    df = B.trades(spark, sf).withColumn("edge", F.expr("pnl div capital"))
    return with_zscore(df).select(*O, "route", r6("z", "z"))


@query(f"""WITH {B.QUOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY venue) AS n FROM quotes)
SELECT venue, max(n) AS n, {s6('sum(power(0.9::DOUBLE, (n-i)::DOUBLE) * latency_ms * CASE WHEN i=1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)', 'ewma')} FROM r GROUP BY venue""")
def latency_ewma(spark, sf):
    out = ewma(B.quotes(spark, sf), ["venue"], ["t", "seq"], "latency_ms", 0.10)
    return out.select("venue", "n", r6("ewma", "ewma"))


@query(f"""{T}, r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY {OSQL}) AS i, count(*) OVER (PARTITION BY route) AS n FROM trades)
SELECT route, max(n) AS n, {s6('power(0.9::DOUBLE, max(n)::DOUBLE) + sum(CASE WHEN pnl>0 THEN power(0.9::DOUBLE, (n-i)::DOUBLE)*0.1::DOUBLE ELSE 0 END)', 'ewma')} FROM r GROUP BY route""")
def route_reliability(spark, sf):
    df = B.trades(spark, sf).withColumn("hit", (F.col("pnl") > 0).cast("double"))
    return ewma(df, ["route"], O, "hit", 0.1, start=1.0).select("route", "n", r6("ewma", "ewma"))


@query(f"""WITH {B.QUOTES_SQL}, i AS (SELECT pair, t, sum(bid_tick+ask_tick) AS s, count(*) AS k FROM quotes GROUP BY pair, t),
m AS (SELECT pair, t, s::DOUBLE/k::DOUBLE AS ref FROM i),
w AS (SELECT *, min(ref) OVER f AS lo, max(ref) OVER f AS hi, count(*) OVER f AS c FROM m WINDOW f AS (PARTITION BY pair ORDER BY t RANGE BETWEEN 10800000000 PRECEDING AND CURRENT ROW))
SELECT pair, t, c > 1 AND (hi-lo)/lo*10000.0::DOUBLE >= 12.0::DOUBLE AS conservative, {s6('(hi-lo)/lo*10000.0::DOUBLE', 'range_bps')} FROM w""")
def volatility_flag(spark, sf):
    q = B.quotes(spark, sf).withColumn("s", F.col("bid_tick") + F.col("ask_tick"))
    pre = {"ref": F.sum("s").cast("double") / F.count("*"), "one": F.lit(1).cast("bigint")}
    over = {"lo": ("min", "ref"), "hi": ("max", "ref"), "c": ("sum", "one")}
    out = rolling_time(q, ["pair"], "t", B.STALE_US, pre, over)
    rng = (F.col("hi") - F.col("lo")) / F.col("lo") * 10000.0
    return out.select("pair", "t", ((F.col("c") > 1) & (rng >= 12.0)).alias("conservative"), r6(rng, "range_bps"))


@query(f"""{T}, d AS (SELECT t, sum(pnl) AS p FROM trades GROUP BY t),
w AS (SELECT t, sum(p) OVER (ORDER BY t RANGE BETWEEN {30 * DAY} PRECEDING AND CURRENT ROW) AS recent FROM d)
SELECT t, recent::BIGINT AS recent, recent < -1000000000 AS breaker FROM w""")
def loss_breaker(spark, sf):
    out = rolling_time(B.trades(spark, sf), [], "t", 30 * DAY, {"p": F.sum("pnl")}, {"recent": ("sum", "p")})
    return out.select("t", "recent", (F.col("recent") < -1_000_000_000).alias("breaker"))


@query(f"""{T}, r AS (SELECT *, row_number() OVER (ORDER BY {OSQL})-1 AS rank, count(*) OVER () AS n FROM trades)
SELECT CASE WHEN rank < n*50//100 THEN 'A' WHEN rank < n*50//100 + n*20//100 THEN 'B' ELSE 'C' END AS part,
 count(*) AS trades, min(t) AS first_t, max(t) AS last_t, sum(pnl)::BIGINT AS pnl FROM r GROUP BY 1""")
def chronological_split(spark, sf):
    from tapelab.operators.backtest import split

    rows = split(B.trades(spark, sf), O, 50, 20)
    return rows.groupBy("part").agg(F.count("*").alias("trades"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("pnl").alias("pnl"))


_CH = f"""{T}, r AS (SELECT route, pnl, row_number() OVER (PARTITION BY route ORDER BY {OSQL})-1 AS rank, count(*) OVER (PARTITION BY route) AS n FROM trades),
c AS (SELECT route, cast(least(rank // ((n + least(n,8) - 1)//least(n,8)), least(n,8)-1) AS INT) AS "window", sum(pnl)::BIGINT AS pnl FROM r GROUP BY ALL)"""


@query(f'{_CH} SELECT route, "window", pnl FROM c')
def window_pnl(spark, sf):
    return risk.chunk_pnl(B.trades(spark, sf), ["route"], O, "pnl")


@query(f"""{_CH} SELECT route, {s6('''CASE WHEN max(pnl)=min(pnl) THEN CASE WHEN avg(pnl)>=0 THEN 1 ELSE 0 END ELSE
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - stddev_pop(pnl)/(abs(avg(pnl))+stddev_pop(pnl)))) END''', 'stability')},
 count(*) FILTER (WHERE pnl<0) AS negative_windows FROM c GROUP BY route""")
def window_stability(spark, sf):
    w = risk.chunk_pnl(B.trades(spark, sf), ["route"], O, "pnl")
    return risk.stability(w, ["route"]).select("route", r6("stability", "stability"), "negative_windows")


@query(f"""WITH {B.QUOTES_SQL}, w AS (SELECT venue, seq, list_sort(list(latency_ms) OVER (PARTITION BY venue ORDER BY t, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS l FROM quotes)
SELECT venue, seq, l[least(floor(len(l)*0.5::DOUBLE)::INT, len(l)-1)+1] AS p50, l[least(floor(len(l)*0.95::DOUBLE)::INT, len(l)-1)+1] AS p95 FROM w""")
def rolling_percentiles(spark, sf):
    q = B.quotes(spark, sf).select("venue", "t", "seq", "latency_ms")
    out = rolling_rows(q, ["venue"], ["t", "seq"], {"l": lambda w: F.array_sort(F.collect_list("latency_ms").over(w.rowsBetween(-99, 0)))}, back=99)

    def at(p):
        n = F.size("l")
        return F.get("l", F.least(F.floor(n * p), n - 1).cast("int"))

    return out.select("venue", "seq", at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(f"""WITH {B.QUOTES_SQL}, g AS (SELECT venue, list_sort(list(latency_ms)) AS l FROM quotes GROUP BY venue)
SELECT venue, l[round((len(l)-1)*0.5::DOUBLE)::INT+1] AS p50, l[round((len(l)-1)*0.95::DOUBLE)::INT+1] AS p95, l[round((len(l)-1)*0.99::DOUBLE)::INT+1] AS p99 FROM g""")
def rank_percentile(spark, sf):
    return rank_percentiles(B.quotes(spark, sf), ["venue"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"""WITH {B.QUOTES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY t DESC, seq DESC) AS r FROM quotes),
g AS (SELECT venue, list_sort(list(latency_ms)) AS l FROM x WHERE r<=100 GROUP BY venue),
a AS (SELECT venue, count(*) AS events, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, arg_max(latency_ms, (t,seq)) AS last_ms FROM quotes GROUP BY venue)
SELECT venue, events, min_ms, max_ms, last_ms, l[least(floor(len(l)*0.5::DOUBLE)::INT, len(l)-1)+1] AS p50_ms,
 l[least(floor(len(l)*0.95::DOUBLE)::INT, len(l)-1)+1] AS p95_ms, l[least(floor(len(l)*0.99::DOUBLE)::INT, len(l)-1)+1] AS p99_ms FROM a JOIN g USING (venue)""")
def latency_summary(spark, sf):
    from tapelab.operators.latency import latency_summary as f

    return f(B.quotes(spark, sf)).select("venue", "events", "min_ms", "max_ms", "last_ms", "p50_ms", "p95_ms", "p99_ms")


@query(f"""WITH {B.QUOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY venue) AS n FROM quotes),
e AS (SELECT venue, sum(power(0.9::DOUBLE, (n-i)::DOUBLE) * latency_ms * CASE WHEN i=1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) AS m FROM r GROUP BY venue)
SELECT venue, row_number() OVER (ORDER BY m, venue) AS place, CASE WHEN m=0 THEN 'esperando mercado' WHEN m > 3000.0::DOUBLE THEN 'latencia alta' ELSE 'estable' END AS state,
 CASE WHEN m>900 THEN 'probar replica mas cercana' ELSE 'iad/us-east' END AS region FROM e""")
def latency_ranking(spark, sf):
    from tapelab.operators.latency import latency_ranking as f

    return f(B.quotes(spark, sf), 4000)


@query(f"""{T}, m AS (SELECT max(t) AS m FROM trades) SELECT count(*) AS trades, sum(pnl)::BIGINT AS pnl, min(t) AS first_t FROM trades, m WHERE t >= m - {60 * DAY}""")
def replay_window(spark, sf):
    # the minutes of the tape are days here: the table spans years
    out = last_minutes(B.trades(spark, sf), "t", 60, unit_us=DAY)
    return out.agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"), F.min("t").alias("first_t"))


@query(f"""{T}, r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY {", ".join(c + " DESC" for c in O)}) AS newest FROM trades) SELECT route, newest, {OSQL} FROM r WHERE newest <= 80""")
def retention_rows(spark, sf):
    return newest(B.trades(spark, sf), ["route"], O, 80).select("route", F.col("newest").cast("bigint").alias("newest"), *O)


@query(f"""{T}, m AS (SELECT max(t)//{DAY} AS m FROM trades) SELECT count(*) AS trades, sum(pnl)::BIGINT AS pnl FROM trades, m WHERE t//{DAY} > m - 90""")
def retention_days(spark, sf):
    return keep_days(B.trades(spark, sf), "t", 90).agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"))


@query(f"""{T}, r AS (SELECT *, row_number() OVER (ORDER BY {", ".join(c + " DESC" for c in O)}) AS newest FROM trades) SELECT newest, route, {OSQL} FROM r WHERE newest<=25""")
def latest_operations(spark, sf):
    from tapelab.operators.retention import latest_rows

    return latest_rows(B.trades(spark, sf), O, 25).select("newest", "route", *O)


@query(f"""{T}, m AS (SELECT max(t) AS m FROM trades) SELECT {OSQL}, route FROM trades, m WHERE t=m""")
def latest_batch_rows(spark, sf):
    return latest_batch(B.trades(spark, sf), "t").select(*O, "route")


@query(f"{T} SELECT buy_venue, max(pnl//capital) FILTER (WHERE sell_venue='S0') AS S0, max(pnl//capital) FILTER (WHERE sell_venue='S1') AS S1, max(pnl//capital) FILTER (WHERE sell_venue='S2') AS S2, max(pnl//capital) FILTER (WHERE sell_venue='S3') AS S3, max(pnl//capital) FILTER (WHERE sell_venue='S4') AS S4 FROM trades GROUP BY buy_venue")
def route_matrix(spark, sf):
    df = B.trades(spark, sf).withColumn("edge", F.expr("pnl div capital"))
    return df.groupBy("buy_venue").pivot("sell_venue", [f"S{i}" for i in range(5)]).agg(F.max("edge"))


@query(f"{T} SELECT buy_venue, sell_venue, count(*) AS seen, count(*) FILTER (WHERE pnl>0) AS executable, max(pnl//capital) AS best_edge FROM trades GROUP BY ALL")
def route_heatmap(spark, sf):
    df = B.trades(spark, sf).withColumn("edge", F.expr("pnl div capital"))
    return df.groupBy("buy_venue", "sell_venue").agg(F.count("*").alias("seen"), F.count_if(F.col("pnl") > 0).alias("executable"), F.max("edge").alias("best_edge"))


# trades as economics: prices and a cost struct derived from the same integers
def economics_rows(spark, sf):
    c = F.col
    df = B.trades(spark, sf).withColumns({
        "buy_price": c("l_extendedprice") / c("qty"), "edge": F.expr("pnl div capital"), "net_usd": c("pnl") / 10000.0})
    df = df.withColumn("sell_price", c("buy_price") + (c("edge") + 4) * c("buy_price") / 100.0)
    part = c("l_extendedprice") / 100.0
    items = {"fee_buy": part, "fee_sell": part, "slippage": part * 0.5, "withdrawal": part * 0.5, "latency": part * 0.5, "adverse": part * 0.25, "total": part * 4.0}
    return df.withColumn("costs", F.struct(*[v.alias(k) for k, v in items.items()]))


_ECO = f"""{T}, e0 AS (SELECT *, l_extendedprice/qty AS buy_price, pnl//capital AS edge, pnl/10000.0::DOUBLE AS net_usd, l_extendedprice/100.0::DOUBLE AS part FROM trades),
e1 AS (SELECT *, buy_price + (edge+4)*buy_price/100.0::DOUBLE AS sell_price FROM e0),
e2 AS (SELECT *, greatest((sell_price-buy_price)*qty, 0.0::DOUBLE) AS gross, part+part AS fees, part*0.5::DOUBLE AS slip, part*0.25::DOUBLE AS impact, part*0.5::DOUBLE AS late, part*0.5::DOUBLE AS moved FROM e1),
e3 AS (SELECT *, fees+slip+impact+late+moved AS known FROM e2),
eco AS (SELECT *, greatest(part*4.0::DOUBLE - known, 0.0::DOUBLE) AS other, greatest(buy_price*qty, 2.220446049250313e-16::DOUBLE) AS notional FROM e3)"""


def _r4(x, n):
    return (F.round(x, 4) + F.lit(0.0)).alias(n)


@query(f"""{_ECO} SELECT item, position, count(*) AS trades, count(*) FILTER (WHERE abs(gross-known-other-net_usd)<=0.01::DOUBLE) AS reconciled,
 round(min(v),4)+0.0 AS lowest, round(max(v),4)+0.0 AS highest FROM (SELECT *, unnest([{{'item':'grossSpread','position':0,'v':gross}},{{'item':'takerFees','position':1,'v':-fees}},{{'item':'slippage','position':2,'v':-slip}},
 {{'item':'marketImpact','position':3,'v':-impact}},{{'item':'latency','position':4,'v':-late}},{{'item':'rebalance','position':5,'v':-moved}},{{'item':'other','position':6,'v':-other}},{{'item':'net','position':7,'v':net_usd}}], recursive := true) FROM eco) GROUP BY item, position""")
def edge_waterfall(spark, sf):
    w = E.waterfall(economics_rows(spark, sf), [])
    return w.groupBy("item", "position").agg(
        F.count("*").alias("trades"), F.count_if("reconciled").alias("reconciled"), _r4(F.min("value_usd"), "lowest"), _r4(F.max("value_usd"), "highest"))


@query(f"""{_ECO} SELECT {OSQL}, round(greatest(net_usd,0.0::DOUBLE),4)+0.0 AS headroom_usd, round(greatest(net_usd,0.0::DOUBLE)/notional*10000.0::DOUBLE,4)+0.0 AS headroom_bps,
 round(part*4.0::DOUBLE/notional*10000.0::DOUBLE,4)+0.0 AS total_cost_bps, round(CASE WHEN part*4.0::DOUBLE>0 THEN gross/(part*4.0::DOUBLE) ELSE 0.0::DOUBLE END,4)+0.0 AS max_cost_multiplier,
 round(fees/notional*10000.0::DOUBLE + greatest(net_usd,0.0::DOUBLE)/notional*10000.0::DOUBLE,4)+0.0 AS fee_limit_bps FROM eco""")
def break_even_frontier(spark, sf):
    out = E.break_even(economics_rows(spark, sf), O, B.MODEL.slippage_bps)
    return out.select(*O, *[_r4(F.col(c), c) for c in ("headroom_usd", "headroom_bps", "total_cost_bps", "max_cost_multiplier", "fee_limit_bps")])


@query(f"""{_ECO}, p AS (SELECT {OSQL}, unnest([0.1,0.25,0.5,0.75,1.0,1.15,1.3,1.5]::DOUBLE[]) AS factor, gross, part*4.0::DOUBLE-slip-impact AS lin, slip+impact AS nl, qty FROM eco),
v AS (SELECT *, gross*factor - greatest(lin,0.0::DOUBLE)*factor - nl*factor*factor AS pnl FROM p),
b AS (SELECT {OSQL}, arg_max(factor, (pnl, factor)) AS factor, max(pnl) AS pnl FROM v GROUP BY {OSQL})
SELECT factor, count(*) AS trades, round(max(pnl),4)+0.0 AS best_pnl FROM b GROUP BY factor""")
def capacity_curve(spark, sf):
    best = E.best_capacity(E.capacity(economics_rows(spark, sf), O, nested=True), O)
    return best.groupBy("factor").agg(F.count("*").alias("trades"), _r4(F.max("pnl_usd"), "best_pnl"))


@query(f"""{_ECO} SELECT {OSQL}, {s6('CASE WHEN abs(net_usd)>0 THEN net_usd ELSE (sell_price-buy_price)*qty - greatest(part*4.0::DOUBLE-impact, 0.0::DOUBLE) END', 'utility')} FROM eco""")
def expected_utility(spark, sf):
    df = economics_rows(spark, sf)
    u = scoring.expected_utility("net_usd", "buy_price", "sell_price", "qty", "costs.total", "costs.adverse")
    return df.select(*O, r6(u, "utility"))


@query(f"""{_Z}, h AS (SELECT *, {_ZV} AS z FROM w), s AS (SELECT *, list_sum([0.4::DOUBLE,0.2,0.2,0.1,0.1]) AS tw,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, pnl/10000.0::DOUBLE/100.0::DOUBLE)) AS f1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE-latency_ms/5000.0::DOUBLE)) AS f2,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, qty/50.0::DOUBLE)) AS f3, 0.9::DOUBLE AS f4, greatest(0.0::DOUBLE, least(1.0::DOUBLE, z/3.0::DOUBLE)) AS f5 FROM h)
SELECT {OSQL}, {s6('(0.4::DOUBLE*f1+0.2::DOUBLE*f2+0.2::DOUBLE*f3+0.1::DOUBLE*f4+0.1::DOUBLE*f5)/tw', 'score')} FROM s""")
def canonical_score(spark, sf):
    df = with_zscore(B.trades(spark, sf).withColumn("edge", F.expr("pnl div capital")))
    s = scoring.canonical_score((0.4, 0.2, 0.2, 0.1, 0.1), F.col("pnl") / 10000.0, "latency_ms", F.lit(5000), "qty", F.lit(50.0), F.lit(0.9), "z")
    return df.select(*O, r6(s, "score"))


@query(f"""{_Z}, h AS (SELECT *, {_ZV} AS z FROM w), s AS (SELECT *, t//86400000000 AS tick,
 round(0.4::DOUBLE*greatest(0.0::DOUBLE, least(1.0::DOUBLE, pnl/10000.0::DOUBLE/100.0::DOUBLE)) + 0.2::DOUBLE*greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE-latency_ms/5000.0::DOUBLE))
 + 0.2::DOUBLE*greatest(0.0::DOUBLE, least(1.0::DOUBLE, qty/50.0::DOUBLE)) + 0.1::DOUBLE*0.9::DOUBLE + 0.1::DOUBLE*greatest(0.0::DOUBLE, least(1.0::DOUBLE, z/3.0::DOUBLE)), 6) AS score FROM h WHERE pnl > 0)
SELECT tick, row_number() OVER (PARTITION BY tick ORDER BY score DESC, {OSQL}) AS position, {OSQL}, score + 0.0 AS score FROM s""")
def ranked_candidates(spark, sf):
    """Winning trades of every day by canonical score."""
    value = B.trade_values()  # computed behind the shuffles, which carry no more than the order
    df = with_zscore(B.trades(spark, sf).select(*O, "route"), value=F.call_function("div", value["pnl"], value["capital"])).withColumns(value)
    s = scoring.canonical_score((0.4, 0.2, 0.2, 0.1, 0.1), F.col("pnl") / 10000.0, "latency_ms", F.lit(5000), "qty", F.lit(50.0), F.lit(0.9), "z")
    df = df.withColumns({"score": r6(s, "score"), "tick": F.floor(F.col("t") / 86_400_000_000), "executable": F.col("pnl") > 0})
    return routes.rank_candidates(df.select("tick", "executable", *O, "score"), ["tick"], "score", O).select("tick", "position", *O, "score")


_H = "CASE WHEN l_linenumber%7=0 THEN NULL ELSE l_linenumber::DOUBLE/7.0::DOUBLE END"
_EX = f"""{_Z}, h AS (SELECT *, {_ZV} AS z, pnl/10000.0::DOUBLE AS u, capital/10000.0::DOUBLE AS cost, {_H} AS hist FROM w),
f AS (SELECT *, greatest((exp(2*u/25.0::DOUBLE)-1)/(exp(2*u/25.0::DOUBLE)+1), 0.0::DOUBLE) AS f1x, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE-latency_ms/5000.0::DOUBLE)) AS f2,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, qty/50.0::DOUBLE)) AS f3, CASE WHEN hist IS NULL THEN 0.58::DOUBLE ELSE greatest(0.05::DOUBLE, least(0.98::DOUBLE, 0.5::DOUBLE+hist*0.08::DOUBLE)) END AS f4,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + tanh(z)/2.0::DOUBLE)) AS f5, tanh(u/25.0::DOUBLE) AS th FROM h),
g AS (SELECT *, greatest(th, 0.0::DOUBLE) AS f1 FROM f),
k AS (SELECT *, 0.4::DOUBLE*f1+0.2::DOUBLE*f2+0.2::DOUBLE*f3+0.1::DOUBLE*f4+0.1::DOUBLE*f5 AS score, greatest(0.0::DOUBLE, least(1.0::DOUBLE, f2*0.56::DOUBLE+f4*0.24::DOUBLE+f5*0.2::DOUBLE)) AS surv,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, f3*0.72::DOUBLE+f4*0.18::DOUBLE+f2*0.1::DOUBLE)) AS fill FROM g)
SELECT {OSQL}, {s6('score','score')}, {s6('surv','survival')}, {s6('fill','fill')}, {s6('(1-surv)*4.0::DOUBLE + greatest(0.0::DOUBLE, least(2.0::DOUBLE, latency_ms/5000.0::DOUBLE))*0.2::DOUBLE','adverse_bps')},
 round(u*surv*fill - cost*(1-fill)*0.12::DOUBLE, 4)+0.0 AS expected_usd, {s6('greatest(0.0::DOUBLE, least(1.0::DOUBLE, score*0.55::DOUBLE+surv*0.25::DOUBLE+fill*0.2::DOUBLE))','confidence')} FROM k"""


@query(_EX.replace("greatest((exp(2*u/25.0::DOUBLE)-1)/(exp(2*u/25.0::DOUBLE)+1), 0.0::DOUBLE) AS f1x, ", ""))
def edge_explanation(spark, sf):
    c = F.col
    df = with_zscore(B.trades(spark, sf).withColumn("edge", F.expr("pnl div capital")))
    df = df.withColumns({
        "weights": F.array(*[F.lit(w) for w in (0.4, 0.2, 0.2, 0.1, 0.1)]), "utility_usd": c("pnl") / 10000.0,
        "cost_usd": c("capital") / 10000.0, "history": F.when(c("l_linenumber") % 7 != 0, c("l_linenumber") / 7.0)})
    out = scoring.explain_edge(df, 50.0, 5000, 4.0, 0.2)
    return out.select(*O, *[r6(x, x) for x in ("score", "survival", "fill", "adverse_bps", "confidence")], _r4(c("expected_usd"), "expected_usd"))


@query(f"{T} SELECT route, concat(route, ':BTC/USD') AS route_pair, concat(buy_venue, ':BTC/USD') AS market, count(*) AS n FROM trades GROUP BY ALL")
def route_keys(spark, sf):
    df = B.trades(spark, sf)
    p = F.lit("BTC/USD")
    return df.groupBy(Q.route("buy_venue", "sell_venue").alias("route"), Q.route_pair("buy_venue", "sell_venue", p).alias("route_pair"),
                      Q.market("buy_venue", p).alias("market")).agg(F.count("*").alias("n"))


@query(f"""{T}, c AS (SELECT route, t//{DAY} AS day, count(*) AS k, sum(pnl)::BIGINT AS pnl FROM trades GROUP BY ALL) SELECT day, max(pnl) AS best FROM c GROUP BY day""")
def best_difference_series(spark, sf):
    day = F.floor(F.col("t") / DAY)
    df = B.trades(spark, sf).groupBy("route", day.alias("day")).agg(F.sum("pnl").alias("pnl"))
    return df.groupBy("day").agg(F.max("pnl").alias("best"))


@query(f"""{T}, r AS (SELECT {OSQL}, row_number() OVER (ORDER BY {OSQL})-1 AS rank FROM trades) SELECT {OSQL}, rank FROM r""")
def global_rank(spark, sf):
    return ranked(B.trades(spark, sf), [], O).select(*O, "rank")


_REPLAY = f"""{T.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT t//1000 AS ms, row_number() OVER (ORDER BY {OSQL})-1 AS i FROM trades),
k AS MATERIALIZED (SELECT (max(ms-i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)+i)::BIGINT AS clock FROM r),
a(clock) AS (SELECT min(clock) FROM k UNION ALL SELECT (SELECT min(k.clock) FROM k WHERE k.clock >= a.clock + 250) FROM a WHERE a.clock IS NOT NULL)"""


@query(f"{_REPLAY} SELECT clock FROM a WHERE clock IS NOT NULL UNION SELECT max(clock) FROM k")
def replay_analyses(spark, sf):
    from tapelab.operators import replay as R

    ticks = R.replay_clock(B.trades(spark, sf).withColumn("ms", F.floor(F.col("t") / 1000)), "ms", O)
    return R.analyses(ticks)


@query(f"""{T}, r AS (SELECT t//1000 AS ms, row_number() OVER (ORDER BY {OSQL})-1 AS i FROM trades), c AS (SELECT max(ms-i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)+i AS clock FROM r)
SELECT count(*) AS ticks, count(DISTINCT clock) AS distinct_clocks, count(DISTINCT clock//250) AS cycles, max(clock) AS last_clock, sum(clock)::BIGINT AS clock_sum FROM c""")
def replay_clock(spark, sf):
    from tapelab.operators.replay import replay_clock as f

    out = f(B.trades(spark, sf).withColumn("ms", F.floor(F.col("t") / 1000)), "ms", O)
    out = stage(out.agg(F.count("*").alias("ticks"), F.count_distinct("clock").alias("distinct_clocks"), F.count_distinct("cycle").alias("cycles"),
                        F.max("clock").alias("last_clock"), F.sum(F.col("clock").cast("decimal(20,0)")).alias("clock_sum")))  # one row
    # a sum of times leaves the longs from some ten million ticks on; it then stays a decimal
    return out.withColumn("clock_sum", F.col("clock_sum").cast("bigint")) if out.where(F.abs("clock_sum") > 2**63 - 1).isEmpty() else out
