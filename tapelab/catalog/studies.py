"""Evaluation, microstructure, mean reversion, impact, bootstrap and parameter studies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tapelab import bindings as B
from tapelab.catalog.base import query, r6, s6, wilson_sql
from tapelab.catalog.scan import cands_sql
from tapelab.config import GRID_IMPACTS, GRID_SCORES, GRID_THRESHOLDS, STRATEGIES, Split
from tapelab.functions import impact as I
from tapelab.operators import backtest as BT
from tapelab.operators import calibration as K
from tapelab.operators import genomes as G
from tapelab.operators import risk
from tapelab.operators.ordered import ranked
from tapelab.plans import bootstrap as BS
from tapelab.plans import evaluate as EV
from tapelab.plans import impact_compare as IC
from tapelab.plans import lab as LAB
from tapelab.plans import meanrev as MR
from tapelab.plans import microstructure as MS
from tapelab.session import stage

DAY = 86_400_000_000
S = replace(B.MODEL, slippage_fallback="zero")
O, OSQL = B.TRADE_ORDER, B.TRADE_ORDER_SQL


def r2(x, name):
    x = x if not isinstance(x, str) else F.col(x)
    return (F.round(x.cast("double"), 2) + F.lit(0.0)).alias(name)


def s2(e, name):
    return f"round(cast({e} AS DOUBLE), 2) + 0.0 AS {name}"


# ---- walk-forward evaluation -------------------------------------------------------------------
def parts(spark, sf):
    return EV.candidate_parts(B.quotes(spark, sf), B.venues(spark), S, by_pair=False)


_PARTS = f"""{cands_sql(False, None)}, ix AS (SELECT *, row_number() OVER (ORDER BY t, seq)-1 AS i, count(*) OVER () AS total FROM cands WHERE sell_venue IS NOT NULL),
parts AS (SELECT *, CASE WHEN i < total*50//100 THEN 'A' WHEN i < total*50//100+total*20//100 THEN 'B' ELSE 'C' END AS part FROM ix),
pr AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY i)-1 AS rank, count(*) OVER (PARTITION BY part) AS n FROM parts)"""


def _rules(strategies) -> str:
    rows = ", ".join(
        f"('{s.name}', {s.max_btc!r}::DOUBLE, '{s.sizing}', {s.latency_ms}, {s.threshold_bps!r}::DOUBLE, {', '.join(f'{float(w)!r}::DOUBLE' for w in s.weights)}, {float(sum(s.weights))!r}::DOUBLE)"
        for s in strategies)
    return f"rules(strategy, max_btc, sizing, lat, own_threshold, w1, w2, w3, w4, w5, tw) AS (VALUES {rows})"


def _grid() -> str:
    pts = [(t, i, f) for t in GRID_THRESHOLDS for i in GRID_IMPACTS for f in GRID_SCORES]
    return "grid(point, threshold, impact, floor) AS (VALUES " + ", ".join(f"({k}, {t!r}::DOUBLE, {i!r}::DOUBLE, {f!r}::DOUBLE)" for k, (t, i, f) in enumerate(pts)) + ")"


_clip = lambda e, lo, hi: f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {e}))"
# rows of one part under every rule: net, score, cause, size, trade and the metrics
_RUN = f"""
g1 AS (SELECT x.*, gross_bps - cost_bps*impact AS net FROM x),
g2 AS (SELECT *, (w1*{_clip('net/10.0::DOUBLE', -1.0, 1.0)} + w2*{_clip('1.0::DOUBLE - latency_ms/10000.0::DOUBLE', 0.0, 1.0)} + w3*{_clip('available/0.5::DOUBLE', 0.0, 1.0)}
  + w4*(CASE WHEN realized_bps>=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + w5*{_clip('abs(gross_bps)/20.0::DOUBLE', 0.0, 1.0)})/greatest(tw, 1e-9) AS score,
  CASE WHEN sizing='kelly' THEN least(max_btc*{_clip('net/20.0::DOUBLE', 0.0, 0.5)}, available) ELSE least(max_btc, available) END AS size FROM g1),
g3 AS (SELECT *, CASE WHEN available<=0 THEN 'sin_liquidez' WHEN latency_ms>lat THEN 'latencia' WHEN net<threshold THEN 'umbral_neto' WHEN score<floor THEN 'score' WHEN size<=0 THEN 'tamano_cero' END AS cause,
  ask*size AS capital, ask*size*cost_bps*impact/10000.0::DOUBLE AS cost FROM g2),
g4 AS (SELECT *, CASE WHEN cause IS NULL THEN capital*(gross_bps+realized_bps)/10000.0::DOUBLE - cost END AS trade,
  least(rank // ((n+least(n,8)-1)//least(n,8)), least(n,8)-1) AS win FROM g3),
g5 AS (SELECT *, sum(trade) OVER (PARTITION BY strategy, point ORDER BY rank ROWS UNBOUNDED PRECEDING) AS path FROM g4 WHERE cause IS NULL),
g6 AS (SELECT *, greatest(max(path) OVER (PARTITION BY strategy, point ORDER BY rank ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) - path AS dd FROM g5),
dds AS (SELECT strategy, point, max(dd) AS max_drawdown_usd FROM g6 GROUP BY strategy, point),
wins AS (SELECT strategy, point, win, coalesce(sum(trade),0) AS p FROM g4 GROUP BY ALL),
ws AS (SELECT strategy, point, avg(p) AS mean, stddev_pop(p) AS sd, count(*) FILTER (WHERE p<0) AS negative_windows, max(p)-min(p) AS spread FROM wins GROUP BY strategy, point),
agg AS (SELECT strategy, point, any_value(threshold) AS threshold, any_value(impact) AS impact, any_value(floor) AS score_floor, count(*) AS orders, count(trade) AS filled, coalesce(sum(trade),0) AS pnl_usd,
  coalesce(sum(2*capital) FILTER (WHERE cause IS NULL),0) AS turnover, coalesce(sum(cost) FILTER (WHERE cause IS NULL),0) AS costs, coalesce(max(capital) FILTER (WHERE cause IS NULL),0) AS max_exposure_usd,
  coalesce(sum(size/greatest(max_btc,1e-9)) FILTER (WHERE cause IS NULL),0)/count(*) AS fill_rate_quantity, coalesce(sum(trade) FILTER (WHERE trade>=0),0) AS gain, coalesce(-sum(trade) FILTER (WHERE trade<0),0) AS loss,
  count(*) FILTER (WHERE trade<0) AS unwinds, count(*) FILTER (WHERE cause='sin_liquidez') AS rej_sin_liquidez, count(*) FILTER (WHERE cause='latencia') AS rej_latencia,
  count(*) FILTER (WHERE cause='umbral_neto') AS rej_umbral_neto, count(*) FILTER (WHERE cause='score') AS rej_score, count(*) FILTER (WHERE cause='tamano_cero') AS rej_tamano_cero FROM g4 GROUP BY strategy, point),
m AS (SELECT a.*, coalesce(max_drawdown_usd,0) AS max_drawdown_usd, CASE WHEN loss>0 THEN gain/loss WHEN gain>0 THEN 'inf'::DOUBLE ELSE 0.0::DOUBLE END AS profit_factor,
  CASE WHEN spread=0 THEN CASE WHEN mean>=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {_clip('1.0::DOUBLE - sd/(abs(mean)+sd)', 0.0, 1.0)} END AS stability, negative_windows,
  pnl_usd - 0.35::DOUBLE*coalesce(max_drawdown_usd,0) AS objective FROM agg a LEFT JOIN dds USING (strategy, point) JOIN ws USING (strategy, point))"""
_COUNTS = ["orders", "filled", "unwinds", "rej_sin_liquidez", "rej_latencia", "rej_umbral_neto", "rej_score", "rej_tamano_cero"]
_MONEY = ["pnl_usd", "max_drawdown_usd", "turnover", "costs", "max_exposure_usd", "fill_rate_quantity", "profit_factor", "stability"]
_PICK = ", ".join(["strategy", "point", *_COUNTS, "negative_windows", *[f"round({c}::DOUBLE,5)+0.0 AS {c}" for c in _MONEY]])


def _metrics(df):
    return df.select("strategy", "point", *_COUNTS, F.col("negative_windows").cast("bigint").alias("negative_windows"),
                     *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in _MONEY])


@query(f"""{_PARTS}, {_rules(STRATEGIES)}, {_grid()}, x AS (SELECT * FROM pr, rules, grid WHERE part='B'), {_RUN} SELECT {_PICK} FROM m""")
def strategy_grid(spark, sf):
    return _metrics(BT.backtest(parts(spark, sf).where("part = 'B'"), BT.grid(STRATEGIES)))


_CAL = f"""cal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round(objective,9) DESC, round(profit_factor,9) DESC, point) AS r FROM m) WHERE r=1)"""


@query(f"""{_PARTS}, {_rules(STRATEGIES)}, {_grid()}, x AS (SELECT * FROM pr, rules, grid WHERE part='B'), {_RUN}, {_CAL} SELECT strategy, point, threshold, impact, score_floor, round(objective,5)+0.0 AS objective FROM cal""")
def calibration(spark, sf):
    best = EV.calibrate(parts(spark, sf))
    return best.select("strategy", "point", "threshold", "impact", "score_floor", (F.round("objective", 5) + F.lit(0.0)).alias("objective"))


def _defaults_sql(part: str) -> str:
    return f"""{_PARTS}, {_rules(STRATEGIES)}, x AS (SELECT *, 0 AS point, own_threshold AS threshold, 1.0::DOUBLE AS impact, 0.0::DOUBLE AS floor FROM pr, rules WHERE part='{part}'), {_RUN}"""


def default_runs(spark, sf, part="C"):
    return BT.backtest(parts(spark, sf).where(F.col("part") == part), [BT.Run(s, 0) for s in STRATEGIES])


@query(f"{_defaults_sql('C')} SELECT {_PICK} FROM m")
def strategy_backtest(spark, sf):
    return _metrics(default_runs(spark, sf))


@query(f"{_defaults_sql('B')} SELECT strategy, round(objective,5)+0.0 AS objective FROM m ORDER BY round(objective,9) DESC, strategy LIMIT 1")
def champion(spark, sf):
    m = default_runs(spark, sf, "B").withColumn("objective", F.round("objective", 9))
    return BT.champion(m).select("strategy", (F.round("objective", 5) + F.lit(0.0)).alias("objective"))


@query(f"""{_defaults_sql('C')}, l AS (SELECT strategy, pnl_usd, max(pnl_usd) OVER () AS top FROM m), w AS (SELECT count(*) AS k, min(strategy) AS s FROM l WHERE abs(top-pnl_usd) <= greatest(abs(top)*1e-9, 1e-9))
SELECT CASE WHEN k>1 THEN 'empate_inconcluso' ELSE s END AS winner, k=1 AND s='campeon_ga_congelado' AS champion_won,
 CASE WHEN k>1 THEN 'empate_inconcluso' WHEN s='campeon_ga_congelado' THEN 'campeon_supera_estrictamente' ELSE 'otra_estrategia_supera' END AS conclusion FROM w""")
def holdout_verdict(spark, sf):
    return BT.holdout_verdict(default_runs(spark, sf), "campeon_ga_congelado")


@query(f"""{_defaults_sql('C')} SELECT (SELECT count(*) FROM pr WHERE part='C') AS candidates, (SELECT count(*) FROM pr WHERE part='C' AND gross_bps>0) AS gross, (SELECT count(*) FROM pr WHERE part='C' AND gross_bps-cost_bps>0) AS net,
 filled, round(filled/greatest((SELECT count(*) FROM pr WHERE part='C' AND gross_bps-cost_bps>0),1),6)+0.0 AS conversion FROM m WHERE strategy='spread_neto_simple'""")
def strategy_funnel(spark, sf):
    filled = default_runs(spark, sf).where("strategy = 'spread_neto_simple'").first()["filled"]
    out = BT.strategy_funnel(parts(spark, sf).where("part = 'C'"), filled)
    return out.select("candidates", "gross", "net", F.col("filled").cast("bigint").alias("filled"), r6("conversion", "conversion"))


@query(f"""{_defaults_sql('C')}, r AS (SELECT strategy, cause, count(*) AS n FROM g4 WHERE cause IS NOT NULL GROUP BY ALL) SELECT strategy, cause, n AS orders FROM r""")
def rejections_by_cause(spark, sf):
    m = default_runs(spark, sf)
    return m.select("strategy", F.explode("rejections").alias("cause", "n")).select("strategy", "cause", F.col("n").cast("bigint").alias("orders"))


@query(f"""{_defaults_sql('C')} SELECT strategy, count(*) AS n, {s6('max(score)','top_score')}, {s6('min(score)','low_score')} FROM g3 GROUP BY strategy""")
def evaluation_scores(spark, sf):
    c = parts(spark, sf).where("part = 'C'")
    cols = [F.struct(F.lit(s.name).alias("strategy"), BT.gate(s)["score"].alias("score")) for s in STRATEGIES]
    rows = c.select(F.inline(F.array(*cols)))
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), r6(F.max("score"), "top_score"), r6(F.min("score"), "low_score"))


@query()
def walk_forward_evaluation(spark, sf):
    out = EV.evaluate(B.quotes(spark, sf), B.venues(spark), S, Split(), by_pair=False)
    v = out["verdict"].join(F.broadcast(out["champion"].select(F.col("strategy").alias("champion"))))
    return out["holdout"].select("strategy", "point", "filled", r2("pnl_usd", "pnl_usd")).join(F.broadcast(v))


# ---- microstructure ----------------------------------------------------------------------------
def micro_quotes(spark, sf):
    # a minute of the table counts as 60 ms here, so that ages and delays have a usable scale
    return B.quotes(spark, sf, levels=True).withColumns({"t": F.expr("t div 1000"), "latency_ms": F.col("latency_ms") / 10.0})


_MQ = f"""WITH {B.QUOTES_SQL}, {B.LEVELS_SQL}, d5 AS (SELECT b.seq, b.d AS bd, a.d AS ad FROM (SELECT seq, sum(qty) AS d FROM bid_levels WHERE lv<5 GROUP BY seq) b JOIN (SELECT seq, sum(qty) AS d FROM ask_levels WHERE lv<5 GROUP BY seq) a USING (seq)),
f0 AS (SELECT venue, pair, t//1000 AS t, q.seq, bid, ask, bid_qty, ask_qty, latency_ms/10.0::DOUBLE AS age_ms, bd, ad, (bid+ask)/2.0::DOUBLE AS mid FROM quotes q JOIN d5 USING (seq) WHERE ask>bid AND bid_qty>0 AND ask_qty>0),
f1 AS (SELECT *, ((ask*bid_qty+bid*ask_qty)/(bid_qty+ask_qty)/mid - 1.0::DOUBLE)*10000.0::DOUBLE AS skew_bps, (bid_qty-ask_qty)/greatest(bid_qty+ask_qty,1e-12) AS l1, (bd-ad)/greatest(bd+ad,1e-12) AS l5, bd+ad AS liquidity,
  {", ".join(f"max(CASE WHEN venue='{v}' THEN t END) OVER (ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS t_{v}" for v in sorted(B.VENUE_BIND))},
  last_value(mid) OVER (PARTITION BY venue, pair ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_mid,
  {", ".join(f"lead(mid,{h}) OVER (PARTITION BY venue, pair ORDER BY t, seq) AS m{h}" for h in (1, 5, 10, 25))} FROM f0),
f2 AS (SELECT *, (t - least({", ".join(f"t_{v}" for v in sorted(B.VENUE_BIND))}))/1000.0::DOUBLE AS async_ms, {", ".join(f"(coalesce(m{h}, last_mid)/mid - 1.0::DOUBLE)*10000.0::DOUBLE AS markout_e{h}" for h in (1, 5, 10, 25))} FROM f1),
smp AS (SELECT *, markout_e1 >= -(ask/bid-1.0::DOUBLE)*5000.0::DOUBLE AS filled,
  1.0::DOUBLE/(1.0::DOUBLE+exp(-{_clip('-0.15::DOUBLE - age_ms/500.0::DOUBLE - async_ms/350.0::DOUBLE + 0.45::DOUBLE*skew_bps + 0.8::DOUBLE*l1 + 1.1::DOUBLE*l5 + 0.03::DOUBLE*ln(1.0::DOUBLE+liquidity)', -30.0, 30.0)})) AS raw,
  1.0::DOUBLE/(1.0::DOUBLE+exp(-{_clip('-2.2::DOUBLE + age_ms/240.0::DOUBLE + async_ms/130.0::DOUBLE - 0.55::DOUBLE*l5 - 0.08::DOUBLE*ln(1.0::DOUBLE+liquidity)', -30.0, 30.0)})) AS leg_risk FROM f2)"""


def micro(spark, sf):
    return MS.samples(micro_quotes(spark, sf))


@query(f"{_MQ} SELECT seq, {s6('skew_bps','skew_bps')}, {s6('l1','imbalance_l1')}, {s6('l5','imbalance_l5')}, {s6('liquidity','liquidity')}, {s6('async_ms','async_ms')}, filled, {s6('raw','raw')}, {s6('leg_risk','leg_risk')} FROM smp")
def microstructure_features(spark, sf):
    return micro(spark, sf).select("seq", *[r6(c, c) for c in ("skew_bps", "imbalance_l1", "imbalance_l5", "liquidity", "async_ms", "raw", "leg_risk")], "filled")


@query(f"{_MQ} SELECT seq, {', '.join(s6(f'markout_e{h}', f'markout_e{h}') for h in (1, 5, 10, 25))} FROM smp")
def event_markouts(spark, sf):
    return micro(spark, sf).select("seq", *[r6(f"markout_e{h}", f"markout_e{h}") for h in (1, 5, 10, 25)])


@query(f"""WITH {B.QUOTES_SQL}, p AS (SELECT venue, pair, seq, t+3600000000 AS due, (bid+ask)/2.0::DOUBLE AS mid FROM quotes)
SELECT p.seq, {s6('((q.bid+q.ask)/2.0::DOUBLE/p.mid - 1.0::DOUBLE)*10000.0::DOUBLE','markout')} FROM p ASOF JOIN quotes q ON p.venue=q.venue AND p.pair=q.pair AND p.due>=q.t""")
def time_markouts(spark, sf):
    from tapelab.operators.markouts import time_markout

    q = B.quotes(spark, sf).select("venue", "pair", "t", "seq", ((F.col("bid") + F.col("ask")) / 2.0).alias("mid"))
    return time_markout(q, ["venue", "pair"], 3_600_000_000).select("seq", r6("markout", "markout"))


_pct = lambda c, q: f"list_sort(list({c}))[round((count(*)-1)*{q}::DOUBLE)::INT+1]"


@query(f"""{_MQ} SELECT venue, count(*) AS observations, {s6('avg(skew_bps)','mean_skew_bps')}, {s6('avg(l5)','mean_imbalance')}, {s6('avg(filled::INT)','fill_rate')},
 {s6(_pct('age_ms', 0.5),'age_p50')}, {s6(_pct('age_ms', 0.95),'age_p95')}, {s6(_pct('async_ms', 0.95),'async_p95')} FROM smp GROUP BY venue""")
def venue_summary(spark, sf):
    s = MS.venue_summary(micro(spark, sf))
    return s.select("venue", "observations", *[r6(c, c) for c in ("mean_skew_bps", "mean_imbalance", "fill_rate", "age_p50", "age_p95", "async_p95")])


@query(f"{_MQ} SELECT {', '.join(s6(f'avg(markout_e{h})', f'markout_e{h}') for h in (1, 5, 10, 25))}, {s6('avg(leg_risk)','mean_leg_risk')} FROM smp")
def markout_means(spark, sf):
    m = MS.markout_means(micro(spark, sf))
    return m.select(*[r6(c, c) for c in m.columns])


@query()
def calibrated_model_metrics(spark, sf):
    return MS.study(micro_quotes(spark, sf))["metrics"]


@query()
def calibration_transfer(spark, sf):
    return MS.study(micro_quotes(spark, sf))["transfer"]


# probabilities and labels from the documents
def labelled(spark, sf):
    d = B.read(spark, sf, "documents").select("doc_id", "n_chars")
    y = B.read(spark, sf, "labels").select("doc_id", "quality")
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("n_chars") / 10000.0))
    return d.join(y, "doc_id").withColumn("p", p)


_LB = "WITH lb AS (SELECT doc_id, quality, greatest(0.001::DOUBLE, least(0.999::DOUBLE, n_chars/10000.0::DOUBLE)) AS p FROM documents JOIN labels USING (doc_id))"


@query(f"{_LB} SELECT count(*) AS observations, {s6('avg((p-quality)*(p-quality))','brier')}, {s6('-avg(CASE WHEN quality=1 THEN ln(p) ELSE ln(1.0::DOUBLE-p) END)','log_loss')} FROM lb")
def calibration_metrics(spark, sf):
    m = labelled(spark, sf).agg(*[v.alias(k) for k, v in K.score_metrics("p", "quality").items()])
    return m.select("observations", r6("brier", "brier"), r6("log_loss", "log_loss"))


_wb = wilson_sql("hits", "observations", "1.959963984540054")
_REL = f"""{_LB}, h AS (SELECT least(floor(p*10),9)::INT AS bin, count(*) AS n, sum(p) AS sp, count(*) FILTER (WHERE quality=1) AS k FROM lb GROUP BY 1),
r AS (SELECT b.bin::INT AS bin, coalesce(n,0) AS observations, coalesce(sp,0.0::DOUBLE) AS sp, coalesce(k,0) AS hits FROM range(10) b(bin) LEFT JOIN h USING (bin))"""


@query(f"{_REL} SELECT bin, observations, {s6('sp/greatest(observations,1)','predicted')}, {s6('hits/greatest(observations,1)','observed')}, {s6(_wb['lower'],'lower')}, {s6(_wb['upper'],'upper')} FROM r")
def reliability_bins(spark, sf):
    r = K.reliability(labelled(spark, sf), "p", "quality")
    return r.select("bin", "observations", *[r6(c, c) for c in ("predicted", "observed", "lower", "upper")])


@query(f"{_REL} SELECT {s6('sum(observations/399.0::DOUBLE*0) + sum(observations*abs(sp/greatest(observations,1) - hits/greatest(observations,1)))/sum(observations)','ece')} FROM r")
def calibration_error(spark, sf):
    return K.calibration_error(K.reliability(labelled(spark, sf), "p", "quality")).select(r6("ece", "ece"))


_SIG = "(1.0::DOUBLE/(1.0::DOUBLE+exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, a*x+b)))))"


@query(f"""{_LB.replace('WITH', 'WITH RECURSIVE', 1)}, c AS MATERIALIZED (SELECT ln(p/(1.0::DOUBLE-p)) AS x, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k, 0.08::DOUBLE/(SELECT count(*) FROM lb) AS scale FROM lb GROUP BY p),
fit(step, a, b) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT step+1, a-sum((n*{_SIG}-k)*x*scale), b-sum((n*{_SIG}-k)*scale) FROM fit, c WHERE step<800 GROUP BY step, a, b)
SELECT doc_id, {s6(_SIG.replace('*x', '*ln(p/(1.0::DOUBLE-p))'), 'calibrated')} FROM lb, (SELECT a, b FROM fit WHERE step=800)""")
def platt_fit(spark, sf):
    df = labelled(spark, sf)
    return df.select("doc_id", r6(K.platt("p", K.fit_platt(df, "p", "quality", cell=1e-6)), "calibrated"))


@query(f"""{_LB}, g AS (SELECT p, sum(quality)::DOUBLE AS s, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY p) AS i FROM lb GROUP BY p),
c AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM g), m AS (SELECT l.i AS l, h.i AS h, (h.cs-l.cs+l.s)/(h.cw-l.cw+l.w) AS mean FROM c l JOIN c h ON l.i<=h.i),
low AS (SELECT l, h, min(mean) OVER (PARTITION BY l ORDER BY h DESC ROWS UNBOUNDED PRECEDING) AS v FROM m), fit AS (SELECT h AS i, max(v) AS v FROM low GROUP BY h)
SELECT doc_id, {s6('lb.p', 'p')}, {s6('v', 'calibrated')} FROM lb JOIN g ON g.p=lb.p JOIN fit USING (i)""")
def isotonic_fit(spark, sf):
    df = labelled(spark, sf)
    return df.select("doc_id", r6("p", "p"), r6(K.isotonic("p", K.fit_isotonic(df, "p", "quality")), "calibrated"))


# ---- mean reversion ----------------------------------------------------------------------------
def spread(spark, sf):
    """Integer spread series per pair, so that sums are exact."""
    return B.quotes(spark, sf).select("pair", "t", "seq", (F.col("bid_tick") + F.col("ask_tick")).cast("double").alias("x"))


_AR = f"""WITH {B.QUOTES_SQL}, x AS (SELECT pair, t, seq, (bid_tick+ask_tick)::DOUBLE AS x, lead(bid_tick+ask_tick) OVER (PARTITION BY pair ORDER BY t, seq)::DOUBLE AS x1 FROM quotes),
r AS (SELECT pair, regr_slope(x1,x) AS beta, regr_sxx(x1,x) AS sxx, regr_syy(x1,x) AS syy, regr_avgx(x1,x) AS mx, regr_avgy(x1,x) AS my, regr_count(x1,x)::BIGINT AS pairs FROM x GROUP BY pair),
s AS (SELECT *, my-beta*mx AS alpha, sqrt(greatest(syy-beta*beta*sxx,0)/greatest(pairs-2,1)) AS sigma FROM r)"""


def fit_rows(spark, sf):
    rows = ranked(spread(spark, sf), ["pair"], ["t", "seq"])
    return MR.ar1(MR.with_neighbours(rows, ["pair"], "x", (1,)), ["pair"])


@query(f"""{_AR} SELECT pair, pairs, {s6('alpha','alpha')}, {s6('beta','beta')}, {s6('sigma','sigma')}, {s6('alpha/(1-beta)','mean')}, {s6("CASE WHEN beta>0 THEN ln(2.0::DOUBLE)/-ln(beta) ELSE 0 END",'half_life')} FROM s""")
def ar1_fit(spark, sf):
    f = fit_rows(spark, sf)
    half = F.when(F.col("beta") > 0, F.col("half_life")).otherwise(0.0)
    return f.select("pair", "pairs", *[r6(c, c) for c in ("alpha", "beta", "sigma", "mean")], r6(half, "half_life"))


@query(f"{_AR} SELECT pair, {s6('(beta-1)/(sigma/sqrt(sxx))','adf')}, (beta-1)/(sigma/sqrt(sxx)) < -2.86 AS adf_rejects FROM s")
def adf_test(spark, sf):
    return fit_rows(spark, sf).select("pair", r6("adf", "adf"), "adf_rejects")


@query(f"""WITH {B.QUOTES_SQL}, x AS (SELECT pair, (bid_tick+ask_tick)::DOUBLE AS x, row_number() OVER (PARTITION BY pair ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY pair) AS n FROM quotes),
m AS (SELECT pair, avg(x) AS mu FROM x GROUP BY pair), e AS (SELECT x.pair, i, n, x-mu AS e, floor(sqrt(n::DOUBLE))::BIGINT AS q FROM x JOIN m USING (pair)),
c AS (SELECT *, sum(e) OVER (PARTITION BY pair ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM e), num AS (SELECT pair, sum(p*p) AS num, sum(e*e)/max(n) AS g0, max(n) AS n, max(q) AS q FROM c GROUP BY pair),
lags AS (SELECT a.pair, a.q, b.i-a.i AS l, sum(a.e*b.e)/max(a.n) AS g FROM e a JOIN e b ON a.pair=b.pair AND b.i>a.i AND b.i<=a.i+a.q GROUP BY ALL),
lr AS (SELECT pair, sum(2.0::DOUBLE*(1.0::DOUBLE-l::DOUBLE/(q+1)::DOUBLE)*g) AS s FROM lags GROUP BY pair)
SELECT num.pair, n, {s6('num/(n::DOUBLE*n::DOUBLE)/greatest(g0+s, 1e-12)','kpss')} FROM num JOIN lr USING (pair)""")
def kpss_test(spark, sf):
    return MR.kpss(spread(spark, sf), ["pair"]).select("pair", "n", r6("kpss", "kpss"))


@query(f"""WITH {B.QUOTES_SQL}, x AS (SELECT pair, (bid_tick+ask_tick)::DOUBLE AS x, row_number() OVER (PARTITION BY pair ORDER BY t, seq)-1 AS i, {", ".join(f"lead((bid_tick+ask_tick)::DOUBLE,{h}) OVER (PARTITION BY pair ORDER BY t, seq) AS x{h}" for h in (1, 2, 3, 5))} FROM quotes),
c(z,h) AS (VALUES (0.75::DOUBLE,1),(1.0,1),(1.25,2),(1.5,3),(2.0,5)),
t AS (SELECT pair, z, h, i, -sign(x-20000.0::DOUBLE)*(CASE h WHEN 1 THEN x1 WHEN 2 THEN x2 WHEN 3 THEN x3 ELSE x5 END - x) AS r FROM x, c WHERE abs(x-20000.0::DOUBLE) >= z*4.0::DOUBLE AND CASE h WHEN 1 THEN x1 WHEN 2 THEN x2 WHEN 3 THEN x3 ELSE x5 END IS NOT NULL),
p AS (SELECT *, sum(r) OVER (PARTITION BY pair, z ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM t), q AS (SELECT *, greatest(max(p) OVER (PARTITION BY pair, z ORDER BY i ROWS UNBOUNDED PRECEDING),0)-p AS d FROM p)
SELECT pair, z, h, count(*) AS trades, {s6('sum(r)','pnl')}, {s6('max(d)','max_drawdown')}, {s6('count(*) FILTER (WHERE r>0)/count(*)','win_rate')} FROM q GROUP BY pair, z, h""")
def threshold_rule_grid(spark, sf):
    rows = MR.with_neighbours(ranked(spread(spark, sf), ["pair"], ["t", "seq"]), ["pair"], "x")
    out = MR.rule_results(MR.candidate_trades(rows, 20000.0, 4.0, keys=["pair"]), ["pair", "z", "h"])
    return out.select("pair", "z", "h", "trades", *[r6(c, c) for c in ("pnl", "max_drawdown", "win_rate")])


def _spread_bps(spark, sf):
    from tapelab.operators.asof import latest_by_venue, spread_series

    s = spread_series(latest_by_venue(B.quotes(spark, sf), ["bid", "ask"], by=[]))
    return stage(s.select("t", "seq", F.col("spread_bps").alias("x")))


@query()
def mean_reversion_study(spark, sf):
    return MR.study(_spread_bps(spark, sf), ["t", "seq"])["holdout"]


@query()
def mean_reversion_decision(spark, sf):
    return MR.study(_spread_bps(spark, sf), ["t", "seq"])["decision"]


@query()
def mean_reversion_windows(spark, sf):
    return MR.study(_spread_bps(spark, sf), ["t", "seq"])["windows"]


@query()
def compact_reversion_lab(spark, sf):
    rows = micro(spark, sf).withColumn("x", F.col("skew_bps") - 0.6 * F.col("imbalance_l5")).select("t", "seq", "x")
    rows = stage(rows)
    return MR.compact_lab(stage(MR.with_neighbours(BT.split(rows, ["t", "seq"], 50, 20), ["part"], "x", (1,))))


# ---- impact models -----------------------------------------------------------------------------
def impact_orders(spark, sf):
    s = F.col("seq")
    q = B.quotes(spark, sf, levels=True)
    return q.select(
        "t", "seq", ((1 + s % 5) / 2.0).alias("qty"), F.col("ask").alias("price"), F.lit(True).alias("is_buy"), F.col("asks").alias("levels"),
        (5.0 + s % 7).alias("volatility"), (250 + s % 4 * 250).alias("horizon_ms"), (1.0 + s % 17 / 2.0).alias("gross_bps"), (s % 13 / 4.0).alias("observed_bps"))


_IMP = f"""WITH {B.QUOTES_SQL}, {B.LEVELS_SQL}, o AS (SELECT t, seq, (1+seq%5)/2.0::DOUBLE AS qty, ask AS price, 5.0::DOUBLE+seq%7 AS vol, 250+seq%4*250 AS hor, 1.0::DOUBLE+(seq%17)/2.0::DOUBLE AS gross, (seq%13)/4.0::DOUBLE AS obs FROM quotes),
lv AS (SELECT l.seq, l.lv, l.price, l.qty AS q, coalesce(sum(l.qty) OVER (PARTITION BY l.seq ORDER BY lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM ask_levels l WHERE l.qty>0),
wk AS (SELECT o.seq, sum(greatest(0.0::DOUBLE, least(q, o.qty-before))) AS got, sum(greatest(0.0::DOUBLE, least(q, o.qty-before))*lv.price) AS paid FROM o JOIN lv USING (seq) GROUP BY o.seq),
md AS (SELECT o.*, 'Book-walk' AS model, coalesce(greatest((paid/got/price-1.0::DOUBLE)*10000.0::DOUBLE,0.0::DOUBLE),0.0::DOUBLE) AS impact, coalesce(got,0.0::DOUBLE) AS fq FROM o LEFT JOIN wk USING (seq)
 UNION ALL SELECT o.*, 'Square-root', 0.72::DOUBLE*vol*sqrt(qty/18000.0::DOUBLE), qty FROM o
 UNION ALL SELECT o.*, 'Almgren-lite', vol*sqrt(qty)*(0.018::DOUBLE*sqrt(750.0::DOUBLE/hor::DOUBLE)+0.012::DOUBLE), qty FROM o),
ac AS (SELECT *, fq>0 AND gross-impact>={B.MODEL.min_net_bps}::DOUBLE AND (gross-impact)*fq*price/10000.0::DOUBLE >= {B.MODEL.min_utility_usd}::DOUBLE AS acc FROM md),
df AS (SELECT a.*, a.acc<>b.acc AS differs FROM ac a JOIN ac b ON a.seq=b.seq AND b.model='Book-walk'),
pt AS (SELECT *, sum((gross-obs)*fq*price/10000.0::DOUBLE) OVER (PARTITION BY model ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS p FROM ac WHERE acc),
dd AS (SELECT model, max(d) AS dd FROM (SELECT model, greatest(max(p) OVER (PARTITION BY model ORDER BY t, seq ROWS UNBOUNDED PRECEDING),0)-p AS d FROM pt) GROUP BY model),
tb AS (SELECT d.model, count(*) AS orders, count(*) FILTER (WHERE acc) AS accepted_orders, count(*) FILTER (WHERE differs) AS different, count(*) FILTER (WHERE acc)/count(*) AS fill_rate, avg(impact) AS mean_impact_bps, avg(abs(impact-obs)) AS mae_bps, avg(impact-obs) AS bias_bps,
 coalesce(avg(fq) FILTER (WHERE acc),0) AS mean_qty, coalesce(sum((gross-obs)*fq*price/10000.0::DOUBLE) FILTER (WHERE acc),0) AS pnl, coalesce(any_value(dd.dd),0) AS max_drawdown FROM df d LEFT JOIN dd USING (model) GROUP BY d.model)"""
_IN = ("fill_rate", "mean_impact_bps", "mae_bps", "bias_bps", "mean_qty")


@query(f"{_IMP} SELECT model, orders, accepted_orders, different, {', '.join(s6(c, c) for c in _IN)}, {s2('pnl','pnl')}, {s2('max_drawdown','max_drawdown')} FROM tb")
def impact_model_comparison(spark, sf):
    return IC.compare(impact_orders(spark, sf), B.MODEL).select("model", "orders", "accepted_orders", "different", *[r6(c, c) for c in _IN], r2("pnl", "pnl"), r2("max_drawdown", "max_drawdown"))


@query(f"{_IMP} SELECT (SELECT model FROM tb ORDER BY mae_bps, model LIMIT 1) AS least_error, (SELECT model FROM tb ORDER BY bias_bps, model LIMIT 1) AS most_underestimating")
def impact_answers(spark, sf):
    return IC.answers(IC.compare(impact_orders(spark, sf), B.MODEL))


@query(f"{_IMP} SELECT seq, model, {s6('impact','impact_bps')}, {s6('fq','fill_qty')} FROM md")
def impact_estimates(spark, sf):
    return IC.model_rows(impact_orders(spark, sf), B.MODEL).select("seq", "model", r6("impact_bps", "impact_bps"), r6("fill_qty", "fill_qty"))


@query("""SELECT CASE WHEN q<=0 THEN 'size must be positive' WHEN p<=0 THEN 'reference price must be positive' WHEN v IS NULL THEN 'volatility missing' ELSE 'ok' END AS reason, count(*) AS orders
FROM (SELECT l_quantity - CASE WHEN l_linenumber=1 THEN 60 ELSE 0 END AS q, l_extendedprice - CASE WHEN l_linenumber=2 THEN 1e9 ELSE 0 END AS p, CASE WHEN l_linenumber<>3 THEN 5.0 END AS v FROM lineitem) GROUP BY 1""")
def impact_guards(spark, sf):
    n = F.col("l_linenumber")
    li = B.read(spark, sf, "lineitem").select(
        (F.col("l_quantity") - F.when(n == 1, 60).otherwise(0)).alias("qty"), (F.col("l_extendedprice") - F.when(n == 2, 1e9).otherwise(0)).alias("price"),
        F.lit(True).alias("is_buy"), F.when(n != 3, 5.0).alias("volatility"), F.lit(500).alias("horizon_ms"))
    e = I.estimate("Square-root", IC.ORDER | {"levels": "qty"})
    return li.groupBy(F.coalesce(e["reason"], F.lit("ok")).alias("reason")).agg(F.count("*").alias("orders"))


# ---- parameter sets over the trade log ---------------------------------------------------------
GENOMES = [
    G.Genome(f"g{i}_{j}_{k}", w, b, c, lat)
    for i, (b, w) in enumerate([(0.0, (0.4, 0.2, 0.2, 0.1, 0.1)), (200.0, (1.0, 0.0, 0.0, 0.0, 0.0)), (400.0, (0.2, 0.2, 0.2, 0.2, 0.2))])
    for j, c in enumerate([10.0, 25.0]) for k, lat in enumerate([2500, 5000])]


def ops(spark, sf):
    c = F.col
    return B.trades(spark, sf).withColumns({
        "buy_price": c("l_extendedprice") / c("qty"), "utility": c("pnl") / 10000.0, "expected": (c("pnl") + c("capital")) / 10000.0})


def _ops_sql(genomes) -> str:
    g = ", ".join(f"('{x.name}', {x.min_bps!r}::DOUBLE, {x.max_btc!r}::DOUBLE, {x.max_latency_ms}, {', '.join(f'{float(w)!r}::DOUBLE' for w in x.weights)})" for x in genomes)
    return f"""WITH {B.TRADES_SQL}, gen(genome, min_bps, cap, tol, w1, w2, w3, w4, w5) AS (VALUES {g}),
ops AS (SELECT *, l_extendedprice/qty AS buy_price, pnl/10000.0::DOUBLE AS utility, (pnl+capital)/10000.0::DOUBLE AS expected FROM trades),
o2 AS (SELECT *, expected/(buy_price*qty)*10000.0::DOUBLE AS net_bps FROM ops),
sel AS (SELECT o2.* EXCLUDE (capital), gen.*, least(qty, cap) AS size, utility*(least(qty,cap)/qty) AS u, expected*(least(qty,cap)/qty) AS e, buy_price*least(qty,cap) AS capital FROM o2 JOIN gen ON net_bps>=min_bps AND latency_ms<=tol),
pth AS (SELECT *, sum(u) OVER (PARTITION BY genome ORDER BY {OSQL} ROWS UNBOUNDED PRECEDING) AS path FROM sel),
ddr AS (SELECT genome, greatest(max(path) OVER (PARTITION BY genome ORDER BY {OSQL} ROWS UNBOUNDED PRECEDING),0)-path AS d FROM pth), dd AS (SELECT genome, max(d) AS max_drawdown FROM ddr GROUP BY genome)"""


_WIN = f"""{_ops_sql(GENOMES)}, win AS (SELECT genome, count(*) AS trades, sum(u) AS pnl, avg(u) AS mean, CASE WHEN count(*)<2 OR stddev_samp(u/capital)=0 THEN 0 ELSE greatest(-5.0::DOUBLE, least(5.0::DOUBLE, avg(u/capital)/stddev_samp(u/capital))) END AS sharpe,
 count(*) FILTER (WHERE u>0)/count(*) AS win_rate, avg(latency_ms) AS mean_latency, count(*) FILTER (WHERE partial)/count(*) AS partial_rate, any_value(tol) AS tol FROM sel GROUP BY genome),
pg AS (SELECT genome, avg(e/capital*10000.0::DOUBLE) AS mu, stddev_samp(e/capital*10000.0::DOUBLE) AS sd, max(size) AS mx, count(*) AS n FROM sel GROUP BY genome),
rt AS (SELECT genome, route, count(*) FILTER (WHERE u>0) AS w, count(*) AS k FROM sel GROUP BY ALL),
sc AS (SELECT s.*, (u>0)::INT AS won, CASE WHEN k>1 THEN (w-(u>0)::INT)/(k-1) ELSE 0.5::DOUBLE END AS rel, (e/capital*10000.0::DOUBLE-mu)/greatest(sd,1e-8) AS z, mx, w1+w2+w3+w4+w5 AS tw FROM sel s JOIN pg USING (genome) JOIN rt USING (genome, route)),
pd AS (SELECT *, {_clip(f"(w1*{_clip('e/100.0::DOUBLE',0.0,1.0)} + w2*{_clip('1.0::DOUBLE-latency_ms/tol::DOUBLE',0.0,1.0)} + w3*{_clip('size/mx',0.0,1.0)} + w4*{_clip('rel',0.0,1.0)} + w5*{_clip('z/3.0::DOUBLE',0.0,1.0)})/tw", 0.0, 1.0)} AS p FROM sc),
wc AS (SELECT genome, avg(1-(p-won)*(p-won)) AS calibration, {_clip('0.5::DOUBLE+avg((p-0.5::DOUBLE)*tanh(u/25.0::DOUBLE))',0.0,1.0)} AS edge FROM pd GROUP BY genome),
ft AS (SELECT *, least(sqrt(greatest(mean,0))*6,35) + sharpe*8 + win_rate*22 + least(sqrt(greatest(pnl,0))*0.8::DOUBLE,40) + calibration*16 + edge*14 - least(max_drawdown/250.0::DOUBLE,30)
 - 12/greatest(trades+12,1)*40 - least(CASE WHEN tol>=mean_latency THEN 0 ELSE (mean_latency-tol)/500.0::DOUBLE END, 20) - partial_rate*5 AS fitness FROM win JOIN dd USING (genome) JOIN wc USING (genome))"""


@query(f"{_WIN} SELECT genome, trades, {s2('pnl','pnl')}, {s2('mean','mean')}, {s6('sharpe','sharpe')}, {s6('win_rate','win_rate')}, {s2('max_drawdown','max_drawdown')}, {s6('mean_latency','mean_latency')}, {s6('partial_rate','partial_rate')} FROM win JOIN dd USING (genome)")
def genome_windows(spark, sf):
    w = G.Population(ops(spark, sf), GENOMES, O).windows()
    return w.select("genome", "trades", r2("pnl", "pnl"), r2("mean", "mean"), r6("sharpe", "sharpe"), r6("win_rate", "win_rate"), r2("max_drawdown", "max_drawdown"), r6("mean_latency", "mean_latency"), r6("partial_rate", "partial_rate"))


@query(f"{_WIN} SELECT genome, {s6('calibration','calibration')}, {s6('edge','edge')} FROM wc")
def weight_calibration(spark, sf):
    w = G.Population(ops(spark, sf), GENOMES, O).calibration()
    return w.select("genome", r6("calibration", "calibration"), r6("edge", "edge"))


def genome_table(spark, sf):
    return G.evaluate(ops(spark, sf), GENOMES, O, failures=12)


@query(f"{_WIN} SELECT genome, round(fitness,4)+0.0 AS fitness, {s2('pnl','o_pnl')}, {s2('-max_drawdown','o_drawdown')} FROM ft")
def genome_fitness(spark, sf):
    return genome_table(spark, sf).select("genome", (F.round("fitness", 4) + F.lit(0.0)).alias("fitness"), r2("o_pnl", "o_pnl"), r2("o_drawdown", "o_drawdown"))


_OBJ = "ob AS (SELECT genome, round(pnl,2) AS o_pnl, round(sharpe,6) AS o_sharpe, round(-max_drawdown,2) AS o_drawdown, round(win_rate,6) AS o_win_rate FROM ft)"


def objectives(spark, sf):
    t = genome_table(spark, sf)
    return t.select("genome", r2("o_pnl", "o_pnl"), r6("o_sharpe", "o_sharpe"), r2("o_drawdown", "o_drawdown"), r6("o_win_rate", "o_win_rate"))


@query(f"""{_WIN}, {_OBJ} SELECT genome FROM ob a WHERE NOT EXISTS (SELECT 1 FROM ob b WHERE b.o_pnl>=a.o_pnl AND b.o_sharpe>=a.o_sharpe AND b.o_drawdown>=a.o_drawdown AND b.o_win_rate>=a.o_win_rate
 AND (b.o_pnl>a.o_pnl OR b.o_sharpe>a.o_sharpe OR b.o_drawdown>a.o_drawdown OR b.o_win_rate>a.o_win_rate))""")
def pareto_frontier(spark, sf):
    return G.frontier(objectives(spark, sf)).select("genome")


_DOM = "a.o_pnl>=b.o_pnl AND a.o_sharpe>=b.o_sharpe AND a.o_drawdown>=b.o_drawdown AND a.o_win_rate>=b.o_win_rate AND (a.o_pnl>b.o_pnl OR a.o_sharpe>b.o_sharpe OR a.o_drawdown>b.o_drawdown OR a.o_win_rate>b.o_win_rate)"


# a row's front is the length of the longest chain of rows above it
_CROWD = " + ".join(f"(lead({o}) OVER (PARTITION BY front ORDER BY {o}, genome) - lag({o}) OVER (PARTITION BY front ORDER BY {o}, genome))/greatest(max({o}) OVER (PARTITION BY front)-min({o}) OVER (PARTITION BY front), 1e-9::DOUBLE)" for o in G.OBJECTIVES)


@query(f"""{_WIN.replace('WITH', 'WITH RECURSIVE', 1)}, {_OBJ}, dm AS MATERIALIZED (SELECT a.genome AS over, b.genome AS under FROM ob a JOIN ob b ON {_DOM}),
ch(genome, front) AS (SELECT genome, 0 FROM ob UNION SELECT dm.under, front+1 FROM ch JOIN dm ON dm.over=ch.genome), fr AS (SELECT genome, max(front)::INT AS front FROM ch GROUP BY genome)
SELECT genome, front, round({_CROWD},6)+0.0 AS crowding FROM fr JOIN ob USING (genome)""")
def pareto_ranks(spark, sf):
    out = G.crowding(G.pareto_ranks(objectives(spark, sf), "genome"), "genome")
    return out.select("genome", "front", F.when(F.col("crowding") < float("inf"), F.round("crowding", 6) + F.lit(0.0)).alias("crowding"))


# the crowding distance alone, over the customers as one population per segment
_CW = """WITH p AS (SELECT c_custkey AS k, c_mktsegment AS front, cast(round(c_acctbal*100) AS bigint)::DOUBLE AS a, (c_custkey*37%1009)::DOUBLE AS b FROM customer),
w AS (SELECT *, lag(a) OVER (PARTITION BY front ORDER BY a, k) AS la, lead(a) OVER (PARTITION BY front ORDER BY a, k) AS na, lag(b) OVER (PARTITION BY front ORDER BY b, k) AS lb, lead(b) OVER (PARTITION BY front ORDER BY b, k) AS nb,
 max(a) OVER (PARTITION BY front)-min(a) OVER (PARTITION BY front) AS sa, max(b) OVER (PARTITION BY front)-min(b) OVER (PARTITION BY front) AS sb FROM p)"""


@query(f"{_CW} SELECT k, CASE WHEN la IS NULL OR na IS NULL OR lb IS NULL OR nb IS NULL THEN NULL ELSE round((na-la)/greatest(sa,1e-9)+(nb-lb)/greatest(sb,1e-9),6)+0.0 END AS crowding FROM w")
def crowding_distance(spark, sf):
    c = B.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("front"), F.round(F.col("c_acctbal") * 100).cast("double").alias("a"), (F.col("c_custkey") * 37 % 1009).cast("double").alias("b"))
    out = G.crowding(c, "k", ("a", "b"))
    return out.select("k", F.when(F.col("crowding") < float("inf"), F.round("crowding", 6) + F.lit(0.0)).alias("crowding"))


@query(f"""WITH w AS (SELECT unnest([0,1,2,3,4]) AS i, unnest([(c_custkey%7)/7.0::DOUBLE,(c_custkey%5)/5.0::DOUBLE,(c_custkey%3)/3.0::DOUBLE,(c_nationkey%4)/4.0::DOUBLE,(c_nationkey%2)/2.0::DOUBLE]) AS w FROM customer)
SELECT {s6('least(1.0::DOUBLE, sqrt(avg(v))*5)','diversity')} FROM (SELECT i, var_pop(w) AS v FROM w GROUP BY i)""")
def population_diversity(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = B.read(spark, sf, "customer").select(F.array(k % 7 / 7.0, k % 5 / 5.0, k % 3 / 3.0, n % 4 / 4.0, n % 2 / 2.0).alias("weights"))
    return G.diversity(c).select(r6("diversity", "diversity"))


_BASE = G.Genome("configuracion_activa", max_btc=18.0, min_bps=100.0)
_SENS = [G.Genome("solo_spread", (0.0,) * 5, 5.0, 18.0), G.Genome("conservador", max_btc=0.05, min_bps=15.0), G.Genome("ev_fijo", (1.0,) * 5, 100.0, 18.0), _BASE]


@query(f"""{_ops_sql(_SENS)} SELECT genome, count(*) AS trades, {s6('CASE WHEN coalesce(sum(u) FILTER (WHERE u<=0),0)=0 THEN greatest(coalesce(sum(u) FILTER (WHERE u>0),0),1) ELSE coalesce(sum(u) FILTER (WHERE u>0),0)/-sum(u) FILTER (WHERE u<=0) END','profit_factor')}, {s6('count(*) FILTER (WHERE u>0)/count(*)','win_rate')},
 {s6(_pct('u',0.5),'median')}, {s6(_pct('u',0.05),'p05')}, {s6(_pct('u',0.95),'p95')}, {s2('sum(u)','pnl')}, {s2('any_value(max_drawdown)','max_drawdown')} FROM sel JOIN dd USING (genome) GROUP BY genome""")
def rule_sensitivity(spark, sf):
    out = G.rule_sensitivity(ops(spark, sf), O, _BASE)
    return out.select("genome", "trades", *[r6(c, c) for c in ("profit_factor", "win_rate", "median", "p05", "p95")], r2("pnl", "pnl"), r2("max_drawdown", "max_drawdown"))


# runs: years of the trade log; accepted: positive edge
def run_rows(spark, sf):
    y = F.year(F.timestamp_micros("t")).cast("int")
    return B.trades(spark, sf).withColumns({"run": y, "accepted": F.col("pnl") > -F.col("capital"), "net_bps": F.expr("pnl div capital").cast("double")})


_RR = f"WITH {B.TRADES_SQL}, rr AS (SELECT *, year(make_timestamp(t))::INT AS run, pnl > -capital AS acc, pnl//capital AS net_bps FROM trades)"
_RDD = f"""pa AS (SELECT run, pnl, {OSQL}, sum(pnl) OVER (PARTITION BY run ORDER BY {OSQL} ROWS UNBOUNDED PRECEDING) AS c FROM rr WHERE acc),
pb AS (SELECT run, greatest(max(c) OVER (PARTITION BY run ORDER BY {OSQL} ROWS UNBOUNDED PRECEDING),0)-c AS d FROM pa), pd AS (SELECT run, max(d)::BIGINT AS max_drawdown FROM pb GROUP BY run)"""
_BLK = f"""{_RR}, {_RDD}, blk AS (SELECT rr.run, count(*) AS routes, count(*) FILTER (WHERE acc) AS trades, coalesce(sum(pnl) FILTER (WHERE acc),0)::BIGINT AS pnl, count(*) FILTER (WHERE acc AND pnl>0)/count(*) FILTER (WHERE acc) AS win_rate, avg(net_bps) FILTER (WHERE acc) AS mean_net_bps,
 avg(pnl) FILTER (WHERE acc) AS mean_pnl, stddev_samp(pnl) FILTER (WHERE acc) AS sd_pnl, list_sort(list(pnl) FILTER (WHERE acc)) AS l, sum(pnl) FILTER (WHERE acc AND pnl>0) AS gain, -sum(pnl) FILTER (WHERE acc AND pnl<0) AS loss, any_value(max_drawdown) AS max_drawdown FROM rr JOIN pd USING (run) GROUP BY rr.run)"""


@query(f"""{_BLK} SELECT run, routes, trades, pnl, max_drawdown, {s6('win_rate','win_rate')}, {s6('mean_net_bps','mean_net_bps')}, {s2('mean_pnl','mean_pnl')}, {s2('sd_pnl','sd_pnl')}, {s2('1.96::DOUBLE*sd_pnl/sqrt(trades)','ci95')},
 l[round((len(l)-1)*0.5::DOUBLE)::INT+1] AS p50, l[round((len(l)-1)*0.95::DOUBLE)::INT+1] AS p95, {s6('CASE WHEN loss>0 THEN gain::DOUBLE/loss::DOUBLE ELSE coalesce(gain,0)::DOUBLE END','profit_factor')} FROM blk""")
def backtest_block(spark, sf):
    b = risk.backtest_block(run_rows(spark, sf), ["run"], O, "pnl", "accepted", "net_bps")
    return b.select("run", "routes", "trades", "pnl", "max_drawdown", r6("win_rate", "win_rate"), r6("mean_net_bps", "mean_net_bps"), r2("mean_pnl", "mean_pnl"), r2("sd_pnl", "sd_pnl"), r2("ci95", "ci95"), "p50", "p95", r6("profit_factor", "profit_factor"))


@query(f"""{_BLK}, a AS (SELECT list_sort(list(pnl)) AS p, list_sort(list(max_drawdown)) AS d, list_sort(list(trades)) AS t, count(*) AS runs, avg(pnl) AS mean_pnl, stddev_samp(pnl) AS sd, count(*) FILTER (WHERE pnl>0) AS positive_runs FROM blk)
SELECT runs, {s2('mean_pnl','mean_pnl')}, {s2('1.96::DOUBLE*sd/sqrt(runs)','ci95_mean')}, positive_runs, p[round((runs-1)*0.5::DOUBLE)::INT+1] AS median_pnl, p[round((runs-1)*0.05::DOUBLE)::INT+1] AS p05_pnl, p[round((runs-1)*0.95::DOUBLE)::INT+1] AS p95_pnl,
 d[round((runs-1)*0.5::DOUBLE)::INT+1] AS median_drawdown, t[round((runs-1)*0.5::DOUBLE)::INT+1] AS median_trades FROM a""")
def run_distribution(spark, sf):
    b = risk.backtest_block(run_rows(spark, sf), ["run"], O, "pnl", "accepted", "net_bps")
    d = risk.run_distribution(b, [])
    return d.select("runs", r2("mean_pnl", "mean_pnl"), r2("ci95_mean", "ci95_mean"), "positive_runs", "median_pnl", "p05_pnl", "p95_pnl", "median_drawdown", "median_trades")


@query(f"""{_BLK} SELECT run, {s2('pnl - max_drawdown*0.55::DOUBLE + win_rate*120 + least(CASE WHEN loss>0 THEN gain::DOUBLE/loss::DOUBLE ELSE coalesce(gain,0)::DOUBLE END, 25)*4 - 1.96::DOUBLE*sd_pnl/sqrt(trades)','lab_score')} FROM blk""")
def lab_scores(spark, sf):
    b = risk.backtest_block(run_rows(spark, sf), ["run"], O, "pnl", "accepted", "net_bps")
    return b.select("run", r2(risk.lab_score("pnl", "max_drawdown", "win_rate", "profit_factor", "ci95"), "lab_score"))


@query(f"""{_RR}, pt(parameter, multiplier) AS (VALUES ('threshold',0.25::DOUBLE),('threshold',0.5),('threshold',1.0),('threshold',1.5),('threshold',2.0),('slippage',0.0),('slippage',0.5),('slippage',1.0),('slippage',2.0),('slippage',4.0)),
h AS (SELECT parameter, multiplier, CASE WHEN parameter='threshold' THEN pnl ELSE pnl - cast(round(capital*multiplier) AS bigint) END AS p FROM rr, pt WHERE CASE WHEN parameter='threshold' THEN net_bps >= 2*multiplier ELSE pnl - cast(round(capital*multiplier) AS bigint) >= 2*capital END)
SELECT parameter, multiplier, count(*) AS trades, sum(p)::BIGINT AS pnl, {s6('count(*) FILTER (WHERE p>0)/count(*)','win_rate')} FROM h GROUP BY ALL""")
def parameter_sensitivity(spark, sf):
    from tapelab.plans.sweep import sensitivity

    s = sensitivity(run_rows(spark, sf), "pnl", "capital", 2.0)
    return s.select("parameter", "multiplier", "trades", "pnl", r6("win_rate", "win_rate"))


@query(f"""{_RR}, h AS (SELECT m, sum(pnl) FILTER (WHERE net_bps >= 2*m)::DOUBLE AS p FROM rr, (VALUES (0.25::DOUBLE),(2.0)) v(m) GROUP BY m) SELECT {s6('(max(p) FILTER (WHERE m=2.0) - max(p) FILTER (WHERE m=0.25))/max(p) FILTER (WHERE m=0.25)','elasticity')} FROM h""")
def threshold_elasticity(spark, sf):
    from tapelab.plans.sweep import elasticity, sensitivity

    return elasticity(sensitivity(run_rows(spark, sf), "pnl", "capital", 2.0)).select(r6("elasticity", "elasticity"))


# rule sets over the recorded routes; a lot of the table stands for 0.01 BTC
_RULES = [LAB.Rule("conservative", 4.0, 8.0), LAB.Rule("balanced", 1.0, 18.0), LAB.Rule("aggressive", -1.0, 35.0), LAB.Rule("champion", 2.0, 24.0)]
_HELD = [LAB.Rule("champion", 2.0, 24.0), LAB.Rule("fixed_conservative", 4.0, 8.0), LAB.Rule("fixed_balanced", 1.0, 18.0), LAB.Rule("net_spread", 0.0, 50.0)]


def _block_sql(rows, *keys, name="blk"):
    """Result block ``name`` per keys of ``rows`` (acc, pnl, net_bps and the order columns)."""
    k, by = ", ".join(keys), f"PARTITION BY {', '.join(keys)} ORDER BY {OSQL}"
    return f"""{name}_a AS (SELECT *, sum(pnl) OVER ({by} ROWS UNBOUNDED PRECEDING) AS c FROM {rows} WHERE acc),
{name}_b AS (SELECT *, greatest(max(c) OVER ({by} ROWS UNBOUNDED PRECEDING),0)-c AS d FROM {name}_a), {name}_d AS (SELECT {k}, max(d)::BIGINT AS max_drawdown FROM {name}_b GROUP BY {k}),
{name}_0 AS (SELECT {k}, count(*) AS routes, count(*) FILTER (WHERE acc) AS trades, coalesce(sum(pnl) FILTER (WHERE acc),0)::BIGINT AS pnl, coalesce(count(*) FILTER (WHERE acc AND pnl>0)/nullif(count(*) FILTER (WHERE acc),0),0) AS win_rate,
 coalesce(avg(net_bps) FILTER (WHERE acc),0) AS mean_net_bps, coalesce(avg(pnl) FILTER (WHERE acc),0) AS mean_pnl, coalesce(stddev_samp(pnl) FILTER (WHERE acc),0) AS sd_pnl, list_sort(list(pnl) FILTER (WHERE acc)) AS l,
 coalesce(sum(pnl) FILTER (WHERE acc AND pnl>0),0)::DOUBLE AS gain, coalesce(-sum(pnl) FILTER (WHERE acc AND pnl<0),0)::DOUBLE AS loss FROM {rows} GROUP BY {k}),
{name} AS (SELECT {name}_0.*, coalesce(max_drawdown,0) AS max_drawdown, CASE WHEN loss>0 THEN gain/loss ELSE gain END AS profit_factor, CASE WHEN trades>1 THEN 1.96::DOUBLE*sd_pnl/sqrt(trades) ELSE 0 END AS ci95,
 coalesce(l[round((len(l)-1)*0.5::DOUBLE)::INT+1],0)::BIGINT AS p50, coalesce(l[round((len(l)-1)*0.95::DOUBLE)::INT+1],0)::BIGINT AS p95 FROM {name}_0 LEFT JOIN {name}_d USING ({k}))"""


def _ruled_sql(rules, where="true"):
    values = ", ".join(f"('{r.name}', {r.min_bps}::DOUBLE, {r.max_size}::DOUBLE)" for r in rules)
    return f"""{_RR}, rl(rule, lo, mx) AS (VALUES {values}), ru AS (SELECT rule, run, rr.* EXCLUDE (pnl, acc, run), net_bps >= lo AS acc,
 CASE WHEN qty > mx THEN cast(round(pnl*mx/qty) AS bigint) ELSE pnl END AS pnl FROM rr, rl WHERE {where})"""


_SPREAD = """ds AS (SELECT rule, count(*) AS runs, avg(pnl) AS mean_pnl, coalesce(1.96::DOUBLE*stddev_samp(pnl)/sqrt(count(*)),0) AS ci95_mean, count(*) FILTER (WHERE pnl>0) AS positive_runs,
 list_sort(list(pnl)) AS p, list_sort(list(max_drawdown)) AS d, list_sort(list(trades)) AS t FROM blk GROUP BY rule),
sp AS (SELECT rule, runs, mean_pnl, ci95_mean, positive_runs, p[round((runs-1)*0.5::DOUBLE)::INT+1] AS median_pnl, p[round((runs-1)*0.05::DOUBLE)::INT+1] AS p05_pnl, p[round((runs-1)*0.95::DOUBLE)::INT+1] AS p95_pnl,
 d[round((runs-1)*0.5::DOUBLE)::INT+1] AS median_drawdown, t[round((runs-1)*0.5::DOUBLE)::INT+1] AS median_trades FROM ds)"""
_RUNS = ["runs", "positive_runs", "median_pnl", "p05_pnl", "p95_pnl", "median_drawdown", "median_trades"]
# the first five years calibrate, the later ones are held out
_HELD_FROM = 1997


_OF = ["pnl", "net_bps", "qty"]


def _points(rules):
    return LAB.points(rules, *_OF)


@query(f"""{_ruled_sql(_RULES)}, {_block_sql('ru', 'rule', 'run')}, {_SPREAD},
{_block_sql('ru', 'rule', name='wh')},
sc AS (SELECT *, pnl - max_drawdown*0.55::DOUBLE + win_rate*120 + least(profit_factor, 25)*4 - ci95 AS s FROM wh)
SELECT rule, trades, pnl, max_drawdown, {s2('s','lab_score')}, {', '.join(_RUNS)}, rule = (SELECT arg_max(rule, (s, rule)) FROM sc) AS best FROM sc JOIN sp USING (rule)""")
def lab_presets(spark, sf):
    """Four rule sets on all routes with their lab score, their spread over the runs, and the best one."""
    out = LAB.presets(run_rows(spark, sf), _points(_RULES), _OF, "run", O)
    return out.select("rule", "trades", "pnl", "max_drawdown", r2("lab_score", "lab_score"), *_RUNS, "best")


@query(f"""{_ruled_sql(_HELD, f'run >= {_HELD_FROM}')}, {_block_sql('ru', 'rule', 'run')}, {_SPREAD},
tp AS (SELECT arg_max(rule, (median_pnl, rule)) AS winner, max(median_pnl) FILTER (WHERE rule='champion') - max(median_pnl) FILTER (WHERE rule<>'champion') AS champion_gap FROM sp)
SELECT rule, {', '.join(_RUNS)}, winner, champion_gap, winner = 'champion' AS champion_wins FROM sp, tp""")
def lab_holdout(spark, sf):
    """The frozen champion against three fixed rules on the held-out years."""
    out = LAB.holdout(run_rows(spark, sf).where(F.col("run") >= _HELD_FROM), _points(_HELD), _OF, "run", O, "champion")
    return out.select("rule", *_RUNS, "winner", "champion_gap", "champion_wins")


@query(f"""{_RR}, pt(parameter, multiplier) AS (VALUES ('threshold',0.25::DOUBLE),('threshold',0.5),('threshold',1.0),('threshold',1.5),('threshold',2.0),('slippage',0.0),('slippage',0.5),('slippage',1.0),('slippage',2.0),('slippage',4.0)),
pr AS (SELECT parameter, multiplier, rr.* EXCLUDE (pnl, net_bps, acc), CASE WHEN parameter='threshold' THEN pnl ELSE pnl - cast(round(capital*multiplier) AS bigint) END AS pnl,
 CASE WHEN parameter='threshold' THEN net_bps::DOUBLE ELSE net_bps-multiplier END AS net_bps, CASE WHEN parameter='threshold' THEN net_bps >= 2*multiplier ELSE net_bps-multiplier >= 2 END AS acc FROM rr, pt), {_block_sql('pr', 'parameter', 'multiplier')},
fs AS (SELECT parameter, arg_min(pnl, multiplier)::DOUBLE AS f FROM blk GROUP BY parameter)
SELECT parameter, multiplier, routes, trades, pnl, max_drawdown, {s6('win_rate','win_rate')}, {s6('mean_net_bps','mean_net_bps')}, {s2('mean_pnl','mean_pnl')}, {s2('sd_pnl','sd_pnl')}, {s2('ci95','ci95')}, p50, p95, {s6('profit_factor','profit_factor')}, {s6('CASE WHEN abs(f) > 1e-9 THEN (pnl-f)/f ELSE 0 END','change')} FROM blk JOIN fs USING (parameter)""")
def sensitivity_blocks(spark, sf):
    """The result block at every point of both sweeps."""
    b = LAB.sensitivity_blocks(run_rows(spark, sf), O, "pnl", "capital", "net_bps", 2.0)
    return b.select("parameter", "multiplier", "routes", "trades", "pnl", "max_drawdown", r6("win_rate", "win_rate"), r6("mean_net_bps", "mean_net_bps"), r2("mean_pnl", "mean_pnl"),
                    r2("sd_pnl", "sd_pnl"), r2("ci95", "ci95"), "p50", "p95", r6("profit_factor", "profit_factor"), r6("change", "change"))


@query(f"""{_RR}, r AS (SELECT route, run, sum(pnl)/10000.0::DOUBLE AS pnl FROM rr GROUP BY ALL), a AS (SELECT route, list_sort(list(pnl)) AS l, count(*) AS runs, coalesce(sum(pnl) FILTER (WHERE pnl>0),0)/greatest(coalesce(-sum(pnl) FILTER (WHERE pnl<=0),0),1) AS pf, count(*) FILTER (WHERE pnl>0)/count(*) AS wr, abs(least(min(pnl),0)) AS wl FROM r GROUP BY route)
SELECT route, runs, {s6('pf','profit_factor')}, {s6('wr','win_rate')}, {s2('wl','worst_loss')}, {s2('l[least(floor(runs*0.5::DOUBLE)::INT, runs-1)+1]','median')}, {s2('l[least(floor(runs*0.05::DOUBLE)::INT, runs-1)+1]','p05')}, {s2('l[least(floor(runs*0.95::DOUBLE)::INT, runs-1)+1]','p95')} FROM a""")
def run_comparison(spark, sf):
    r = run_rows(spark, sf).groupBy("route", "run").agg((F.sum("pnl") / 10000.0).alias("pnl"))
    c = G.run_comparison(r, ["route"])
    return c.select("route", "runs", r6("profit_factor", "profit_factor"), r6("win_rate", "win_rate"), *[r2(x, x) for x in ("worst_loss", "median", "p05", "p95")])


# ---- resampling --------------------------------------------------------------------------------
def daily(spark, sf):
    """Two rules over the same days: every trade, and only fast trades with an edge above zero."""
    day = F.floor(F.col("t") / DAY)
    t = B.trades(spark, sf).withColumn("day", day)
    pick = (F.col("latency_ms") < 3000) & (F.col("pnl") > -F.col("capital"))
    a = t.groupBy("day").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("fills"), F.count("*").alias("routes"))
    b = t.groupBy("day").agg(F.coalesce(F.sum(F.when(pick, F.col("pnl"))), F.lit(0)).alias("pnl"), F.count_if(pick).alias("fills"))
    s = BS.paired_series(a, b, ["day"])
    return ranked(s, [], ["day"]).withColumnRenamed("rank", "tick").drop("n")


_DAY = f"""WITH {B.TRADES_SQL}, dl AS (SELECT t//{DAY} AS day, sum(pnl)::BIGINT AS base, coalesce(sum(pnl) FILTER (WHERE latency_ms<3000 AND pnl>-capital),0)::BIGINT AS cand, count(*) AS base_fills, count(*) FILTER (WHERE latency_ms<3000 AND pnl>-capital) AS cand_fills, count(*) AS routes FROM trades GROUP BY 1),
sr AS (SELECT *, row_number() OVER (ORDER BY day)-1 AS tick FROM dl)"""


@query(f"{_DAY} SELECT tick, day, base, cand, base_fills, cand_fills, routes FROM sr")
def paired_series(spark, sf):
    return daily(spark, sf).select("tick", "day", "base", "cand", "base_fills", "cand_fills", "routes")


_SEED = 20260712
_draw = lambda *p, seed=f"'{_SEED}'": f"('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(f'cast({x} AS VARCHAR)' for x in p)})), 1, 15))::BIGINT"
# every resample of every block length, as rows of ticks
_BOOT = f"""{_DAY}, nn AS (SELECT count(*) AS n FROM sr), bl(block, seed) AS (VALUES {', '.join(f"({b}, '{_SEED + i}')" for i, b in enumerate(BS.BLOCKS))}),
dr AS (SELECT block, r, j, {_draw('r', 'j', seed='seed')} % (n-least(block,n)+1) AS start, n FROM bl, nn, range({BS.RESAMPLES}) a(r), range(1000) b(j) WHERE j < (n+block-1)//block),
rs AS (SELECT block, r, j*block+k AS pos, base, cand, base_fills, cand_fills, routes FROM dr, range({max(BS.BLOCKS)}) c(k) JOIN sr ON sr.tick = start+k WHERE k < block AND j*block+k < n),
cs AS (SELECT *, sum(base) OVER w AS pb, sum(cand) OVER w AS pc FROM rs WINDOW w AS (PARTITION BY block, r ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ds AS (SELECT *, greatest(max(pb) OVER w,0)-pb AS db, greatest(max(pc) OVER w,0)-pc AS dc FROM cs WINDOW w AS (PARTITION BY block, r ORDER BY pos ROWS UNBOUNDED PRECEDING)),
mt AS (SELECT block, r, sum(base)::DOUBLE AS b_pnl, sum(cand)::DOUBLE AS c_pnl, max(db)::DOUBLE AS b_drawdown, max(dc)::DOUBLE AS c_drawdown, sum(base_fills)/sum(routes) AS b_fill, sum(cand_fills)/sum(routes) AS c_fill FROM ds GROUP BY block, r)"""
_INTERVALS = f"""{_BOOT}, lg AS (SELECT block, unnest(['b_pnl','c_pnl','d_pnl','b_drawdown','c_drawdown','d_drawdown','b_fill','c_fill','d_fill']) AS metric, unnest([b_pnl, c_pnl, c_pnl-b_pnl, b_drawdown, c_drawdown, c_drawdown-b_drawdown, b_fill, c_fill, c_fill-b_fill]) AS v FROM mt),
ls AS (SELECT block, metric, list_sort(list(v)) AS l FROM lg GROUP BY block, metric) SELECT block::INT AS block, metric, {', '.join(s6(f'l[round((len(l)-1)*{q}::DOUBLE)::INT+1]', n) for n, q in (('median', 0.5), ('lower', 0.025), ('upper', 0.975)))} FROM ls"""


def boot(spark, sf):
    s = stage(daily(spark, sf))
    return BS.all_lengths(s, s.count(), _SEED)


@query(f"{_BOOT} SELECT block::INT AS block, r, b_pnl, c_pnl, b_drawdown, c_drawdown, {s6('b_fill','b_fill')}, {s6('c_fill','c_fill')} FROM mt")
def bootstrap_resamples(spark, sf):
    """10,000 resamples of every block length."""
    return boot(spark, sf).select("block", "r", "b_pnl", "c_pnl", "b_drawdown", "c_drawdown", r6("b_fill", "b_fill"), r6("c_fill", "c_fill"))


def intervals(spark, sf):
    return BS.bootstrap(stage(boot(spark, sf)), ["block"]).select("block", "metric", *[r6(c, c) for c in ("median", "lower", "upper")])


@query(_INTERVALS)
def bootstrap_intervals(spark, sf):
    return intervals(spark, sf)


@query(f"""{_BOOT}, ls AS (SELECT block, list_sort(list(c_pnl-b_pnl)) AS l, count(*) FILTER (WHERE c_pnl>b_pnl)/count(*) AS p FROM mt GROUP BY block) SELECT block::INT AS block, {s6('p','p_better')},
 CASE WHEN l[round((len(l)-1)*0.025::DOUBLE)::INT+1]<=0 AND l[round((len(l)-1)*0.975::DOUBLE)::INT+1]>=0 THEN 'resultado inconcluso' WHEN l[round((len(l)-1)*0.025::DOUBLE)::INT+1]>0 THEN 'candidato superior' ELSE 'baseline superior' END AS result FROM ls""")
def bootstrap_verdict(spark, sf):
    rows = stage(boot(spark, sf))
    return BS.verdict(rows, BS.bootstrap(rows, ["block"]), ["block"]).select("block", r6("p_better", "p_better"), "result")


@query(f"""SELECT block, count(*) AS metrics, {s6('max(upper-lower)', 'widest')} FROM ({_INTERVALS}) GROUP BY block""")
def bootstrap_block_lengths(spark, sf):
    """How wide the intervals get with the block length."""
    return intervals(spark, sf).groupBy("block").agg(F.count("*").alias("metrics"), r6(F.max(F.col("upper") - F.col("lower")), "widest"))


_BSUM = f"{_DAY}, bs AS (SELECT tick//60 AS block, sum(cand-base)::BIGINT AS delta FROM sr GROUP BY 1)"


@query(f"{_BSUM} SELECT count(*) AS blocks, {s6('avg(delta)/greatest(stddev_samp(delta),1e-12)','dz')} FROM bs")
def effect_size(spark, sf):
    return BS.effect_size(BS.block_sums(daily(spark, sf), 60)).select("blocks", r6("dz", "dz"))


@query(f"""{_BSUM}, pm AS (SELECT r, sum(CASE WHEN {_draw('r', 'block')} % 2 = 0 THEN delta ELSE -delta END) AS s FROM bs, range(10000) a(r) GROUP BY r), ob AS (SELECT sum(delta) AS o FROM bs)
SELECT any_value(o)::BIGINT AS observed, {s6('(count(*) FILTER (WHERE abs(s)>=abs(o))+1)/10001','p_value')} FROM pm, ob""")
def permutation_test(spark, sf):
    return BS.permutation_test(BS.block_sums(daily(spark, sf), 60), 10_000, _SEED).select("observed", r6("p_value", "p_value"))


@query(f"""WITH d AS (SELECT o_orderpriority AS name, count(*) FILTER (WHERE o_orderstatus='P')/count(*)/10.0::DOUBLE AS p_value FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS k, count(*) OVER () AS m FROM d)
SELECT name, {s6('p_value','p_value')}, {s6('least(1.0::DOUBLE, max((m-k+1)*p_value) OVER (ORDER BY p_value, name ROWS UNBOUNDED PRECEDING))','p_holm')} FROM r""")
def holm_adjustment(spark, sf):
    o = B.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.count_if(F.col("o_orderstatus") == "P") / F.count("*") / 10.0).alias("p_value"))
    return BS.holm(o).select("name", r6("p_value", "p_value"), r6("p_holm", "p_holm"))


@query(f"""{_DAY}, nn AS (SELECT count(*) AS n FROM sr) SELECT ((tick >= n//5)::INT + (tick >= 2*n//5)::INT + (tick >= 3*n//5)::INT + (tick >= 4*n//5)::INT)::INT AS "window", sum(cand-base)::BIGINT AS delta, sum(cand-base)>0 AS favourable FROM sr, nn GROUP BY 1""")
def five_window_stability(spark, sf):
    s = daily(spark, sf)
    return BS.five_windows(s, s.count())


