"""Corpora, index, audit logs, ledgers, execution reports, exports, health."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapelab import bindings as B
from tapelab.catalog.base import query, r6, s6
from tapelab.operators.ordered import ranked
from tapelab.plans import corpus as CP
from tapelab.plans import execution_audit as X
from tapelab.plans import health as H
from tapelab.plans import ledger_audit as L
from tapelab.session import default_parts, stage, staging_dir
from tapelab.sources import audit_log as AL
from tapelab.sources import exports as EX
from tapelab.sources import files as FI
from tapelab.sources import index as IX
from tapelab.sources import ledger as LG
from tapelab.sources import normalise as NZ
from tapelab.sources import tape as TP

DAY = 86_400_000_000


def folder(spark, name):
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- corpora -----------------------------------------------------------------------------------
def manifests(spark, sf):
    return CP.derive_manifests(B.shard_events(spark, sf))


def shards(spark, sf):
    m = manifests(spark, sf)
    return m.withColumns({
        "sha256": F.sha2("shard", 256), "commit": F.lit("0123456789abcdef0123456789abcdef01234567"), "dirty": F.lit(False), "policy": F.lit(CP.LOSS_POLICY),
        "classification": F.lit("public_market_capture")})


_MAN = f"""WITH {B.SHARDS_SQL}, man AS (SELECT shard, count(*) AS events, count(*) FILTER (WHERE snapshot) AS snapshots, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE rest) AS rest,
 count(*) FILTER (WHERE reconnected) AS reconnects, sum(bytes)::BIGINT AS bytes, min(t) AS started, max(t) AS ended, list_sort(list(DISTINCT venue)) AS venues, list_sort(list(DISTINCT pair)) AS pairs, sha256(shard) AS sha256,
 (max(t)-min(t))//1000 AS duration_ms FROM shard_events GROUP BY shard)"""
_MC = "shard, events, snapshots, gaps, rest, reconnects, bytes, started, ended, duration_ms"


@query(f"{_MAN} SELECT {_MC}, array_to_string(venues, ',') AS venues, array_to_string(pairs, ',') AS pairs FROM man")
def manifest_derivation(spark, sf):
    return manifests(spark, sf).select(*_MC.split(", "), F.array_join("venues", ",").alias("venues"), F.array_join("pairs", ",").alias("pairs"))


@query(f"WITH {B.SHARDS_SQL} SELECT shard, venue, count(*) AS events FROM shard_events GROUP BY ALL")
def shard_venue_counts(spark, sf):
    return manifests(spark, sf).select("shard", F.explode("by_venue").alias("venue", "events"))


@query(f"""{_MAN}, d AS (SELECT * FROM man WHERE shard NOT LIKE '%-11')
SELECT shard, 'counts' AS reason FROM d WHERE shard LIKE '%-03' UNION ALL SELECT shard, 'bytes' FROM d WHERE shard LIKE '%-05' AND bytes>1 UNION ALL SELECT shard, 'window' FROM d WHERE shard LIKE '%-07'
UNION ALL SELECT shard, 'venue_counts' FROM d WHERE shard LIKE '%-09' UNION ALL SELECT shard, 'no_manifest' FROM man WHERE shard LIKE '%-11'""")
def manifest_reconciliation(spark, sf):
    m = manifests(spark, sf)
    s = F.col("shard")
    bad = m.where(~s.endswith("-11")).withColumns({
        "events": F.col("events") + F.when(s.endswith("-03"), 1).otherwise(0), "bytes": F.col("bytes") - F.when(s.endswith("-05"), 1).otherwise(0),
        "ended": F.col("ended") - F.when(s.endswith("-07"), 1).otherwise(0),
        "by_venue": F.transform_values("by_venue", lambda k, v: v + F.when(s.endswith("-09"), 1).otherwise(0))})
    return CP.reconcile(m, bad)


_OV = f"""{_MAN}, a AS (SELECT shard, started, ended, venues, pairs, sha256 FROM man UNION ALL SELECT concat(shard, 'x'), started + 15*{DAY}, ended + 15*{DAY}, venues, pairs, sha256(concat(shard,'x')) FROM man WHERE shard LIKE '%-04'),
e AS (SELECT shard, started, ended, sha256, v AS venue, p AS pair FROM a, unnest(venues) u(v), unnest(pairs) q(p) WHERE started<ended)"""


@query(f"{_OV}, o AS (SELECT *, max({{'ended': ended, 'shard': shard}}) OVER (PARTITION BY venue, pair ORDER BY started, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM e) SELECT shard, prior.shard AS with_shard, venue, pair FROM o WHERE started < prior.ended")
def shard_overlaps(spark, sf):
    s = shards(spark, sf).select("shard", "started", "ended", "venues", "pairs", "sha256")
    x = s.where(F.col("shard").endswith("-04")).select(
        F.concat("shard", F.lit("x")).alias("shard"), (F.col("started") + 15 * DAY).alias("started"), (F.col("ended") + 15 * DAY).alias("ended"), "venues", "pairs",
        F.sha2(F.concat("shard", F.lit("x")), 256).alias("sha256"))
    return CP.overlaps(s.unionByName(x))


@query("SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_contents(spark, sf):
    return CP.duplicate_shards(B.read(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256")))


@query(f"""{_MAN} SELECT count(*) AS shards, sum(events)::BIGINT AS events, sum(snapshots)::BIGINT AS snapshots, sum(gaps)::BIGINT AS gaps, sum(bytes)::BIGINT AS bytes, sum(duration_ms)::BIGINT AS duration_ms, (max(ended)-min(started))//1000 AS span_ms,
 (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT venue AS v FROM shard_events)) AS venues, sha256(concat(string_agg(sha256, chr(10) ORDER BY started), chr(10))) AS corpus_sha256 FROM man""")
def corpus_rollup(spark, sf):
    r = CP.rollup(shards(spark, sf))
    return r.select("shards", "events", "snapshots", "gaps", "bytes", "duration_ms", "span_ms", F.array_join("venues", ",").alias("venues"), "corpus_sha256")


@query(f"""{_MAN}, v AS (SELECT venue, count(*) AS n FROM shard_events GROUP BY venue), r AS (SELECT count(*) AS shards, sum(events)::BIGINT AS events, sum(gaps)::BIGINT AS gaps, sum(duration_ms)::BIGINT AS duration_ms FROM man)
SELECT shards, events, (SELECT count(*) FROM v) >= 2 AS multi_venue, (SELECT bool_and(n >= greatest(duration_ms//5000, 2)) FROM v) AS venue_coverage, greatest(duration_ms//5000, 2) AS events_needed, shards>=10 AS ten_shards, events>=100000 AS preliminary_100k, events>=1000000 AS million_events,
 duration_ms>=86400000 AS full_day, true AS loss_accounted, gaps/greatest(events,1) <= 0.01 AS gap_rate_ok, true AS clean, true AS single_commit, 'public_market_capture_corpus' AS corpus_class,
 'insufficient_scale' AS status, false AS publishable FROM r""")
def evidence_gates(spark, sf):
    return CP.gates(shards(spark, sf))


@query(f"""WITH {B.SHARDS_SQL}, s AS (SELECT shard, min(t) AS a, max(t) AS b FROM shard_events GROUP BY shard) SELECT max(b)-min(a) AS span_us, sum(b-a)::BIGINT AS captured_us, max(b)-min(a)-sum(b-a)::BIGINT AS unobserved_us FROM s""")
def observation_gaps(spark, sf):
    m = manifests(spark, sf)
    out = m.agg((F.max("ended") - F.min("started")).alias("span_us"), F.sum(F.col("ended") - F.col("started")).alias("captured_us"))
    return out.withColumn("unobserved_us", F.col("span_us") - F.col("captured_us"))


@query("""SELECT count(DISTINCT o_orderpriority) AS venues, count(DISTINCT o_orderstatus) AS classes, count(DISTINCT o_orderstatus)=1 AS single_class, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)) AS names FROM orders""")
def set_accumulation(spark, sf):
    o = B.read(spark, sf, "orders")
    return o.agg(F.count_distinct("o_orderpriority").alias("venues"), F.count_distinct("o_orderstatus").alias("classes"), (F.count_distinct("o_orderstatus") == 1).alias("single_class"),
                 F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("names"))


# ---- index -------------------------------------------------------------------------------------
def index_tables(spark, sf):
    a = IX.index_tables(shards(spark, sf), "c1", F.lit(1))
    b = IX.index_tables(shards(spark, sf).where(F.col("shard") >= "1995-01"), "c2", F.lit(2))
    return {t: a[t].unionByName(b[t]) for t in IX.TABLES}


def _page(after: str) -> str:
    return f"""{_MAN}, f AS (SELECT shard, sha256, started, events FROM man WHERE shard >= '1995-01' AND list_contains(venues, '1-URGENT') AND list_contains(pairs, 'P0') AND {after}),
p AS (SELECT *, row_number() OVER (ORDER BY started, sha256) AS r, count(*) OVER () AS n FROM f) SELECT shard, sha256, started, events, n > 12 AS has_more FROM p WHERE r<=12"""


@query(_page("true"))
def index_first_page(spark, sf):
    return IX.query_index(index_tables(spark, sf), venue="1-URGENT", pair="P0", limit=12).select("shard", "sha256", "started", "events", "has_more")


@query(_page("(started, sha256) > (SELECT started, sha256 FROM (SELECT *, row_number() OVER (ORDER BY started, sha256) AS r FROM man WHERE shard >= '1995-01' AND list_contains(venues, '1-URGENT') AND list_contains(pairs, 'P0')) WHERE r=12)").replace("(started, sha256) > (SELECT started, sha256 FROM", "(started, sha256) > (SELECT (started, sha256) FROM"))
def index_next_page(spark, sf):
    t = index_tables(spark, sf)
    last = IX.query_index(t, venue="1-URGENT", pair="P0", limit=12).orderBy(F.col("started").desc(), F.col("sha256").desc()).first()
    return IX.query_index(t, venue="1-URGENT", pair="P0", limit=12, after=(last["started"], last["sha256"])).select("shard", "sha256", "started", "events", "has_more")


@query(f"""{_MAN} SELECT 'corpus' AS name, 1::BIGINT AS n FROM man LIMIT 1""".replace("SELECT 'corpus' AS name, 1::BIGINT AS n FROM man LIMIT 1", """SELECT 'corpus' AS name, 1::BIGINT AS n UNION ALL SELECT 'shard', count(*) FROM man UNION ALL SELECT 'exchange_count', count(DISTINCT venue) FROM shard_events
 UNION ALL SELECT 'shard_exchange', sum(len(venues))::BIGINT FROM man UNION ALL SELECT 'shard_pair', sum(len(pairs))::BIGINT FROM man"""))
def index_replace(spark, sf):
    """Writing one corpus twice leaves one copy of every row."""
    path = folder(spark, "index")
    t = IX.index_tables(stage(shards(spark, sf)), "c1", F.lit(1))
    for _ in range(2):
        IX.write_index(t, path)
    out = None
    for name, df in IX.read_index(spark, path).items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# ---- audit log ---------------------------------------------------------------------------------
def log(spark, sf):
    o = B.read(spark, sf, "orders")
    kind = "operacion"
    return AL.log_rows(o, kind, F.expr("o_orderkey div 4"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderpriority"), F.col("o_orderstatus"))


@query("""WITH n AS (SELECT o_orderkey // 4 AS id, min(o_orderdate) AS time FROM orders GROUP BY 1) SELECT cast(id AS varchar) AS id, epoch_us(time) AS t FROM n WHERE id % 3 <> 0""")
def claimed_insert(spark, sf):
    new = log(spark, sf)
    keys = new.where(F.col("id").cast("bigint") % 3 == 0).select("kind", "id")
    return AL.unclaimed(new, keys).select("id", F.unix_micros("time").alias("t"))


@query("SELECT year(d)::INT AS year, count(*) AS rows FROM (SELECT min(o_orderdate) AS d FROM orders GROUP BY o_orderkey // 4) GROUP BY 1")
def audit_append(spark, sf):
    """Two appends of the same rows to a log on disk."""
    path = folder(spark, "log")
    for _ in range(2):
        AL.append(log(spark, sf).withColumn("time", F.date_trunc("year", "time")), path)
    return AL.read_log(spark, path).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("rows"))


@query("SELECT cast(l_orderkey*10+l_linenumber AS varchar) AS id, epoch_us(min(l_shipdate)) AS t FROM lineitem GROUP BY l_orderkey*10+l_linenumber")
def duplicate_repair(spark, sf):
    li = B.read(spark, sf, "lineitem")
    rows = AL.log_rows(li, "operacion", F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_shipdate").cast("timestamp"))
    return AL.repair_duplicates(rows).select("id", F.unix_micros("time").alias("t"))


@query("""WITH k AS (SELECT cast(o_orderkey // 4 AS varchar) AS id, min(o_orderdate) AS a FROM orders GROUP BY 1), l AS (SELECT DISTINCT cast(o_orderkey // 4 AS varchar) AS id FROM orders WHERE o_orderkey % 7 = 0)
SELECT id, epoch_us(a) AS claimed_us FROM k WHERE a >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY OR id IN (SELECT id FROM l)""")
def key_purge(spark, sf):
    o = log(spark, sf)
    now = F.lit(o.agg(F.max("time")).first()[0])
    left = B.read(spark, sf, "orders").where("o_orderkey % 7 = 0")
    kept = AL.log_rows(left, "operacion", F.expr("o_orderkey div 4"), F.col("o_orderdate").cast("timestamp"))
    return AL.purge_keys(AL.seed_keys(o), kept, now).select("id", F.unix_micros("claimed_at").alias("claimed_us"))


# ---- ledgers -----------------------------------------------------------------------------------
def money(spark, sf):
    c = F.col
    led = B.ledger(spark, sf)
    return led.withColumns({
        "qty": F.lit(1).cast("bigint"), "price": c("notional"), "reference": c("notional") - c("fee"), "cost": c("fee"), "btc": F.lit(0).cast("bigint"), "usd": c("notional"),
        "to_venue": F.lit("1-URGENT")})


@query(f"""WITH {B.LEDGER_SQL} SELECT ledger, coalesce(sum(notional) FILTER (WHERE kind='fill' AND side='buy'),0)::BIGINT AS bought, coalesce(sum(notional) FILTER (WHERE kind='fill' AND side='sell'),0)::BIGINT AS sold,
 coalesce(sum(fee) FILTER (WHERE kind='fill' AND side='buy'),0)::BIGINT AS buy_fees, coalesce(sum(fee) FILTER (WHERE kind='fill' AND side='sell'),0)::BIGINT AS sell_fees,
 coalesce(sum(CASE WHEN side='buy' THEN fee ELSE -fee END) FILTER (WHERE kind='fill'),0)::BIGINT AS slippage, coalesce(sum(fee) FILTER (WHERE kind='rebalance'),0)::BIGINT AS rebalance_cost,
 (count(*) FILTER (WHERE kind='fill' AND side='buy') - count(*) FILTER (WHERE kind='fill' AND side='sell'))::BIGINT AS residual FROM ledger GROUP BY ledger""")
def ledger_totals(spark, sf):
    return L.totals(money(spark, sf)).select("ledger", "bought", "sold", "buy_fees", "sell_fees", "slippage", "rebalance_cost", "residual")


_BAL = f"""WITH {B.LEDGER_SQL}, d AS (SELECT ledger, sequence, id, venue AS at_venue, CASE WHEN side='buy' THEN 1 ELSE -1 END AS btc, CASE WHEN side='buy' THEN -(notional+fee) ELSE notional-fee END AS usd FROM ledger WHERE kind='fill'
 UNION ALL SELECT ledger, sequence, id, venue, 0, -(notional+fee) FROM ledger WHERE kind='rebalance' UNION ALL SELECT ledger, sequence, id, '1-URGENT', 0, notional FROM ledger WHERE kind='rebalance')"""


def initial(spark, sf):
    led = money(spark, sf).select("ledger", F.col("venue").alias("at")).distinct()
    return led.select("ledger", "at", F.lit(5).cast("bigint").alias("btc"), F.lit(500_000_000).cast("bigint").alias("usd"))


@query(f"""{_BAL}, i AS (SELECT DISTINCT ledger, venue FROM ledger), e AS (SELECT ledger, sequence, id, at_venue, btc, usd, 1 AS o FROM d UNION ALL SELECT ledger, 0, '', venue, 5, 500000000, 0 FROM i),
r AS (SELECT ledger, sequence, id, at_venue, o, sum(btc) OVER w AS b, sum(usd) OVER w AS u FROM e WINDOW w AS (PARTITION BY ledger, at_venue ORDER BY sequence RANGE UNBOUNDED PRECEDING))
SELECT DISTINCT ledger, id, at_venue AS "at", b::BIGINT AS btc_after, u::BIGINT AS usd_after FROM r WHERE o=1""")
def running_balances(spark, sf):
    b = L.running_balances(L.deltas(money(spark, sf)), initial(spark, sf))
    return b.select("ledger", "id", "at", "btc_after", "usd_after")


@query(f"""{_BAL}, i AS (SELECT DISTINCT ledger, venue FROM ledger) SELECT ledger, at_venue AS "at", sum(btc)::BIGINT AS btc, sum(usd)::BIGINT AS usd FROM (SELECT ledger, at_venue, btc, usd FROM d UNION ALL SELECT ledger, venue, 5, 500000000 FROM i) GROUP BY ALL""")
def final_balances(spark, sf):
    return L.final_balances(L.deltas(money(spark, sf)), initial(spark, sf))


@query(f"""{_BAL}, i AS (SELECT DISTINCT ledger, venue FROM ledger), e AS (SELECT ledger, sequence, id, at_venue, btc, usd, 1 AS o FROM d UNION ALL SELECT ledger, 0, '', venue, 5, 500000000, 0 FROM i),
r AS (SELECT ledger, id, at_venue, o, sum(btc) OVER w AS b, sum(usd) OVER w AS u FROM e WINDOW w AS (PARTITION BY ledger, at_venue ORDER BY sequence RANGE UNBOUNDED PRECEDING))
SELECT ledger, count(DISTINCT id) AS events FROM r WHERE o=1 AND (b<0 OR u<0) GROUP BY ledger""")
def negative_balances(spark, sf):
    b = L.running_balances(L.deltas(money(spark, sf)), initial(spark, sf))
    return L.negative_balances(b).groupBy("ledger").agg(F.count_distinct("id").alias("events"))


def tampered(spark, sf):
    """A chain with a removed row, a changed amount and a wrong number here and there."""
    led = B.ledger(spark, sf)
    prev = led.select("ledger", (F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("_p"))
    led = led.join(prev, ["ledger", "sequence"], "left").withColumn("previous", F.coalesce("_p", F.lit("GENESIS")))
    k = F.col("o_orderkey")
    led = led.where(k % 97 != 0).withColumn("notional", F.col("notional") + F.when(k % 89 == 0, 1).otherwise(0))
    return led.withColumn("text", F.concat_ws("|", "ledger", F.col("sequence").cast("string"), "kind", "side", F.col("notional").cast("string")))


@query(f"""WITH {B.LEDGER_SQL}, c AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY ledger ORDER BY sequence), 'GENESIS') AS previous FROM ledger),
k AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY sequence) AS pos, coalesce(lag(hash) OVER (PARTITION BY ledger ORDER BY sequence), 'GENESIS') AS link FROM c WHERE o_orderkey%97<>0)
SELECT ledger, id, 'sequence' AS error FROM k WHERE sequence<>pos UNION ALL SELECT ledger, id, 'chain' FROM k WHERE previous<>link UNION ALL SELECT ledger, id, 'hash' FROM k WHERE o_orderkey%89=0""")
def hash_chain_audit(spark, sf):
    return L.chain_errors(tampered(spark, sf), F.col("text"), ["sequence"])


@query("""SELECT concat('L', cast(o_custkey%50 AS varchar)) AS ledger, count(*) AS lines, min(o_orderkey) AS first_sequence, max(o_orderkey) AS last_sequence, sum(cast(round(o_totalprice*100) AS bigint))::BIGINT AS cents,
 count(*) FILTER (o_orderkey%89=0) AS bad_hashes FROM orders GROUP BY 1""")
def ledger_lines(spark, sf):
    """Hash-chained ledgers written as JSON lines and read again; one stored hash in 89 does not cover its line."""
    c = F.col
    quoted = lambda name, v: F.concat(F.lit(f'"{name}":"'), v, F.lit('"'))
    o = B.read(spark, sf, "orders").select(
        F.concat(F.lit("L"), (c("o_custkey") % 50).cast("string")).alias("ledger"), c("o_orderkey").alias("sequence"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
        F.lit("fill").alias("event"), F.concat(F.lit('{"cents":'), F.round(c("o_totalprice") * 100).cast("bigint").cast("string"), F.lit(',"note":"a \\"b\\" ü"}')).alias("payload"),
        F.sha2((c("o_orderkey") - 1).cast("string"), 256).alias("previous"))
    o = o.withColumn("hash", F.when(c("sequence") % 89 == 0, F.sha2(F.lit("other"), 256)).otherwise(LG.line_hash()))
    line = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"sequence":'), c("sequence").cast("string")), quoted("timestamp", c("timestamp")), quoted("event", c("event")),
                                           F.concat(F.lit('"payload":'), c("payload")), quoted("previousHash", c("previous")), quoted("hash", c("hash"))), F.lit("}"))
    path = folder(spark, "lines")
    o.select("ledger", line.alias("value")).write.partitionBy("ledger").text(path)
    read = LG.read_jsonl_ledger(spark, f"{path}/*/*").withColumn("ledger", F.regexp_extract("ledger", "ledger=([^/]+)/", 1))
    return read.groupBy("ledger").agg(
        F.count("*").alias("lines"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
        F.sum(F.get_json_object("payload", "$.cents").cast("bigint")).alias("cents"), F.count_if(c("hash") != LG.line_hash()).alias("bad_hashes"))


def ledger_documents(spark, sf):
    """A ledger document per 50 customers, one file each, with chained hashes; fees of some orders are changed after hashing."""
    c = F.col
    cents = F.round(c("o_totalprice") * 100).cast("bigint")
    money = lambda x: F.format_string("%d.%02d", F.expr(f"{x} div 100"), F.expr(f"{x} % 100"))
    o = B.read(spark, sf, "orders").withColumns({
        "cents": cents, "fee": F.expr("cast(round(o_totalprice * 100) as bigint) div 1000"), "ledger": F.expr("o_custkey div 50")})
    event = F.struct("o_orderdate", "o_orderkey", "o_orderpriority", money("cents").alias("price"), money("fee").alias("fee"))
    # more orders, more documents; a document is chained and written by the task that gathers it, and small text is much work, so tasks are not merged
    docs = o.repartition(default_parts(spark), "ledger").groupBy("ledger").agg(F.array_sort(F.collect_list(event)).alias("rows"))
    fields = F.transform("rows", lambda r: F.struct(
        r["o_orderkey"].alias("key"), F.concat(F.lit('e"'), r["o_orderkey"].cast("string")).alias("id"), F.concat(F.lit("f"), r["o_orderkey"].cast("string")).alias("fill_id"),
        r["o_orderpriority"].alias("exchange"), F.lit("buy").alias("side"), F.lit("0.010").alias("quantity_btc"), r["price"].alias("execution_price_usd"), r["fee"].alias("fee_usd")))
    number = lambda i: (i + 1).cast("bigint")
    hashed = lambda x, i: F.to_json(F.struct(
        x["id"].alias("id"), number(i).alias("sequence"), F.lit("").alias("previous_hash"), F.struct(
            F.lit("fill").alias("type"), x["fill_id"].alias("fill_id"), x["exchange"].alias("exchange"), x["side"].alias("side"), x["quantity_btc"].alias("quantity_btc"),
            x["execution_price_usd"].alias("execution_price_usd"), x["execution_price_usd"].alias("reference_price_usd"), x["fee_usd"].alias("fee_usd")).alias("data")))
    kept = lambda x, i: F.struct(
        x["id"].alias("id"), number(i).alias("sequence"), F.when(i == 0, F.lit(L.GENESIS)).otherwise(F.get("hashes", i - 1)).alias("previousHash"), F.get("hashes", i).alias("hash"),
        F.lit("fill").alias("type"), x["fill_id"].alias("fill_id"), x["exchange"].alias("exchange"), x["side"].alias("side"), x["quantity_btc"].alias("quantity_btc"),
        x["execution_price_usd"].alias("execution_price_usd"), x["execution_price_usd"].alias("reference_price_usd"),
        F.when(x["key"] % 89 == 0, F.concat(x["fee_usd"], F.lit("0"))).otherwise(x["fee_usd"]).alias("fee_usd"))
    chained = docs.withColumn("fields", fields).withColumn("hashes", LG.chained_hashes(L.GENESIS)(F.transform("fields", hashed))).withColumn("events", F.transform("fields", kept))
    doc = F.to_json(F.struct(F.lit("1").alias("version"), F.concat(F.lit("c"), c("ledger").cast("string")).alias("runId"), c("events"),
                             F.size("events").alias("eventCount"), F.element_at("hashes", -1).alias("headHash")))
    path = folder(spark, "documents")
    chained.select("ledger", doc.alias("value")).write.partitionBy("ledger").text(path)
    return f"{path}/*/*"


@query("""WITH e AS (SELECT o_custkey//50 AS ledger, concat('e"', cast(o_orderkey AS varchar)) AS id, o_orderkey%89=0 AS bad, lag(o_orderkey%89=0) OVER w AS after_bad, lead(o_orderkey) OVER w IS NULL AS last
 FROM orders WINDOW w AS (PARTITION BY o_custkey//50 ORDER BY o_orderdate, o_orderkey))
SELECT ledger, id, 'hash' AS error FROM e WHERE bad UNION ALL SELECT ledger, id, 'chain' FROM e WHERE after_bad UNION ALL SELECT ledger, '', 'head' FROM e WHERE bad AND last""")
def document_hashes(spark, sf):
    """Ledger documents on disk whose amounts were changed under intact links; a zero behind a fee is a change too."""
    errors = L.document_hash_errors(LG.read_ledger_texts(spark, ledger_documents(spark, sf)))
    return errors.withColumn("ledger", F.regexp_extract("ledger", "ledger=([0-9]+)/", 1).cast("bigint"))


@query("""SELECT o_custkey//50 AS ledger, count(*) AS events, sum(cast(round(o_totalprice*100) AS bigint))::BIGINT AS price_cents, sum(cast(round(o_totalprice*100) AS bigint)//1000)::BIGINT AS fee_cents FROM orders GROUP BY 1""")
def ledger_documents_read(spark, sf):
    """Ledger documents on disk read as events with decimal amounts."""
    ev = L.document_events(LG.ledger_events(LG.read_ledgers(spark, ledger_documents(spark, sf))))
    return ev.groupBy(F.regexp_extract("ledger", "ledger=([0-9]+)/", 1).cast("bigint").alias("ledger")).agg(
        F.count("*").alias("events"), F.sum(F.col("price") * 100).cast("bigint").alias("price_cents"), F.sum(F.col("fee") * 100).cast("bigint").alias("fee_cents"))


@query("SELECT concat('L', cast(o_custkey%50 AS varchar)) AS ledger, concat('f', cast(o_orderkey//2 AS varchar)) AS id, 'duplicate_fill' AS error FROM orders GROUP BY o_custkey%50, o_orderkey//2 HAVING count(*)>1")
def duplicate_fills(spark, sf):
    led = B.read(spark, sf, "orders").select(F.concat(F.lit("L"), (F.col("o_custkey") % 50).cast("string")).alias("ledger"), F.concat(F.lit("f"), F.expr("o_orderkey div 2").cast("string")).alias("fill_id"))
    return L.duplicates(led, "fill_id", "duplicate_fill")


@query(f"""WITH {B.LEDGER_SQL}, h AS (SELECT ledger, count(*) AS n, arg_max(hash, sequence) AS hh FROM ledger GROUP BY ledger) SELECT ledger, '' AS id, unnest(CASE WHEN ledger IN ('L3','L13') THEN ['count'] WHEN ledger='L7' THEN ['head'] ELSE []::VARCHAR[] END) AS error FROM h""")
def ledger_heads(spark, sf):
    led = B.ledger(spark, sf)
    heads = led.groupBy("ledger").agg(F.count("*").alias("event_count"), F.max_by("hash", "sequence").alias("head_hash"))
    heads = heads.withColumns({"event_count": F.col("event_count") + F.when(F.col("ledger").isin("L3", "L13"), 1).otherwise(0), "head_hash": F.when(F.col("ledger") == "L7", "x").otherwise(F.col("head_hash"))})
    return L.head_errors(led, heads)


@query(f"""{_BAL}, i AS (SELECT DISTINCT ledger, venue FROM ledger), s AS (SELECT ledger, count(*)*5 AS b0, count(*)*500000000 AS u0 FROM i GROUP BY ledger), f AS (SELECT ledger, sum(btc) AS b, sum(usd) AS u FROM d GROUP BY ledger)
SELECT ledger, b::BIGINT AS residual, (u + b*1000)::BIGINT AS recomputed, CASE WHEN ledger='L9' THEN 0 ELSE (u+b*1000)::BIGINT END AS reported, (u + b*1000) = CASE WHEN ledger='L9' THEN 0 ELSE u+b*1000 END AS result_matches, ledger<>'L11' AS balances_match FROM f""")
def ledger_result_check(spark, sf):
    m, i = money(spark, sf), initial(spark, sf)
    fin = L.final_balances(L.deltas(m), i)
    decl = fin.withColumn("usd", F.col("usd") + F.when(F.col("ledger") == "L11", 1).otherwise(0))
    tot = fin.groupBy("ledger").agg(F.sum("btc").alias("b"), F.sum("usd").alias("u")).join(i.groupBy("ledger").agg(F.sum("btc").alias("b0"), F.sum("usd").alias("u0")), "ledger")
    net = F.col("u") - F.col("u0") + (F.col("b") - F.col("b0")) * 1000
    heads = tot.select("ledger", F.lit(1000).alias("mark"), F.when(F.col("ledger") == "L9", 0).otherwise(net).cast("bigint").alias("reported"))
    return L.result_check(fin, i, decl, heads)


@query()
def average_cost(spark, sf):
    led = B.ledger(spark, sf).where("kind = 'fill'").withColumn("qty", F.col("o_orderkey") % 9 + 1)
    return L.average_cost(led, 1000.0)


# ---- execution reports -------------------------------------------------------------------------
def execution(spark, sf):
    """Two-leg executions from the trades: one report per order with wallets, entries and fills."""
    t = B.trades(spark, sf).select(F.col("seq").alias("execution_id"), "l_linenumber", "l_partkey", "l_suppkey", "buy_venue", "sell_venue", "capital", "pnl", F.col("qty").cast("bigint").alias("qty"))
    k = F.col("execution_id")
    zero = F.lit(0).cast("bigint")
    buy = F.struct(F.col("buy_venue").alias("venue"), (-F.col("capital")).alias("usd"), F.col("qty").alias("btc"))
    sell = F.struct(F.col("sell_venue").alias("venue"), (F.col("capital") + F.expr("pnl div 100")).alias("usd"), (-F.col("qty")).alias("btc"))
    entries = t.select("execution_id", F.inline(F.array(buy, sell))).withColumns({"reserved_usd": zero, "reserved_btc": zero})
    moved = entries.groupBy("execution_id", "venue").agg(F.sum("usd").alias("_u"), F.sum("btc").alias("_b"))
    usd, btc = F.lit(100_000_000).cast("bigint"), F.lit(200).cast("bigint")
    before = moved.select("execution_id", "venue", usd.alias("usd"), btc.alias("btc"), zero.alias("reserved_usd"), zero.alias("reserved_btc"))
    after = moved.where("execution_id IS NOT NULL").select(
        "execution_id", "venue", (usd + F.col("_u") + F.when(k % 50 == 0, 1).otherwise(0)).alias("usd"), (btc + F.col("_b")).alias("btc"),
        F.when(k % 60 == 0, 1).otherwise(0).cast("bigint").alias("reserved_usd"), zero.alias("reserved_btc"))
    sizes = stage(t.groupBy("execution_id").agg(F.count("*").alias("_n")))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    fills = ranked(t, ["execution_id"], ["l_linenumber", "l_partkey", "l_suppkey", "capital", "pnl", "qty"], largest=largest).select(
        "execution_id", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("fill_id"), (F.col("rank") + 1).alias("position"),
        (F.col("rank") + 1 + F.when(k % 70 == 0, 1).otherwise(0)).alias("sequence"))
    reports = sizes.select("execution_id").withColumns({
        "state": F.when(k % 80 == 0, "Leg2TimedOut").otherwise("Reconciled"), "residual": F.when(k % 90 == 0, 1).otherwise(0).cast("bigint"),
        "releases": F.when(k % 110 == 0, 2).otherwise(1)})
    return X.invariants(reports, before, after, entries, fills)


_EXE = f"""WITH {B.TRADES_SQL}, en AS (SELECT seq AS id, buy_venue AS v, -capital AS usd, qty::BIGINT AS btc FROM trades UNION ALL SELECT seq, sell_venue, capital + cast(trunc(pnl/100.0::DOUBLE) AS BIGINT), -qty::BIGINT FROM trades),
w AS (SELECT id, v, 100000000+sum(usd) + CASE WHEN id%50=0 THEN 1 ELSE 0 END AS au, sum(usd) AS du, 200+sum(btc) AS ab, CASE WHEN id%60=0 THEN 1 ELSE 0 END AS ru FROM en GROUP BY id, v),
g AS (SELECT id, sum(au)-100000000*count(*) = sum(du) AS pnl_matches, sum(ab)=200*count(*) AS btc_conserved, bool_and(id%50<>0 AND id%60<>0) AS replayed, bool_and(au>=0 AND ab>=0 AND ru<=au) AS no_negative, sum(ab)-200*count(*) AS res FROM w GROUP BY id),
fl AS (SELECT seq AS id, max(n)=1 AS fills_unique FROM (SELECT seq, l_linenumber, count(*) AS n FROM trades GROUP BY ALL) GROUP BY seq),
ck AS (SELECT g.id AS execution_id, g.id%80<>0 AS terminal, g.id%90<>0 AS residual_ok, btc_conserved, res = CASE WHEN g.id%90=0 THEN 1 ELSE 0 END AS wallet_equation, replayed AS ledger_replayed, pnl_matches, fills_unique, g.id%70<>0 AS fills_in_order, g.id%110<>0 AND g.id%60<>0 AS released_once, no_negative FROM g JOIN fl USING (id)),
al AS (SELECT *, terminal AND residual_ok AND btc_conserved AND wallet_equation AND ledger_replayed AND pnl_matches AND fills_unique AND fills_in_order AND released_once AND no_negative AS all_passed FROM ck)"""


@query(f"{_EXE} SELECT * FROM al")
def execution_invariants(spark, sf):
    return execution(spark, sf)


@query(f"{_EXE} SELECT execution_id%12 AS scenario, count(*) AS total, count(*) FILTER (WHERE all_passed) AS passed, bool_and(all_passed) AS all_passed FROM al GROUP BY 1")
def execution_matrix(spark, sf):
    return X.matrix(execution(spark, sf).withColumn("scenario", F.col("execution_id") % 12), "scenario")


# Names of execution states.
_STATES = ("Detected", "Reserved", "Leg1Submitted", "Leg1Filled", "Leg2Submitted", "Leg2Filled", "Reconciled")


@query(f"""WITH s AS (SELECT o_custkey AS execution_id, o_orderkey AS step, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS i FROM orders),
t AS (SELECT execution_id, step, {list(_STATES)}[1 + CASE WHEN step%13=0 THEN 6 ELSE i%7 END] AS state FROM s), p AS (SELECT *, lag(state) OVER (PARTITION BY execution_id ORDER BY step) AS f FROM t)
SELECT execution_id, step, f AS from_state, state FROM p WHERE (coalesce(f,''), state) NOT IN ({", ".join(f"('{a or ''}','{b}')" for a, b in X.EDGES)})""")
def transition_audit(spark, sf):
    o = ranked(B.read(spark, sf, "orders").select(F.col("o_custkey").alias("execution_id"), F.col("o_orderkey").alias("step")), ["execution_id"], ["step"])
    i = F.when(F.col("step") % 13 == 0, 6).otherwise(F.col("rank") % 7).cast("int")
    t = o.select("execution_id", "step", F.get(F.array(*[F.lit(s) for s in _STATES]), i).alias("state"))
    return X.transition_errors(t)


@query(f"""{_EXE} SELECT unnest(['operationIdsUnique','visibleOperationsWithinTotal','terminalReconciled','residualBtcZero','walletEquation','ledgerReconciled','fillsExactlyOnce','reservationsReleasedOnce']) AS "check",
 unnest([true, true, bool_and(terminal), bool_and(residual_ok), bool_and(wallet_equation AND btc_conserved), bool_and(ledger_replayed AND pnl_matches), bool_and(fills_unique AND fills_in_order), bool_and(released_once)]) AS passed FROM al""")
def snapshot_ledger_checks(spark, sf):
    return X.snapshot_checks(B.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), execution(spark, sf))


# ---- seal and publication ----------------------------------------------------------------------
def evidence(spark, sf):
    c = B.read(spark, sf, "customer")
    k = F.col("c_custkey")
    pub, syn = F.lit("public_market_capture_corpus"), F.lit("synthetic_benchmark_corpus")
    sha = lambda p, x=k: F.sha2(F.concat(F.lit(p), x.cast("string")), 256)
    reports = c.select(k.alias("report_id"), F.when(k % 11 == 0, syn).otherwise(pub).alias("classification"), sha("c").alias("corpus_sha256"), sha("r").alias("report_sha256"), (k * 10).alias("total_events"))
    scans = c.where(k % 7 != 0).select(k.alias("report_id"), F.when(k % 13 == 0, syn).otherwise(pub).alias("classification"), F.when(k % 5 == 0, sha("x")).otherwise(sha("c")).alias("corpus_sha256"), sha("s").alias("scan_sha256"),
                                       sha("m").alias("cost_model_sha256"), (k % 17).alias("net"), (k % 7).alias("liquid_net"))
    seals = c.where(k % 3 != 0).select(k.alias("report_id"), F.when(k % 19 == 0, sha("y")).otherwise(sha("c")).alias("corpus_sha256"), sha("r").alias("report_sha256"), sha("s").alias("scan_sha256"))
    return reports, scans, seals


@query("""SELECT c_custkey AS report_id, CASE WHEN c_custkey%11=0 THEN 'invalid_corpus_report' WHEN c_custkey%3=0 OR c_custkey%19=0 THEN 'unsealed_evidence' WHEN c_custkey%7=0 THEN 'missing_scan' WHEN c_custkey%13=0 THEN 'non_public_scan' WHEN c_custkey%5=0 THEN 'corpus_hash_mismatch' ELSE 'matched_corpus' END AS status,
 NOT (c_custkey%11=0 OR c_custkey%3=0 OR c_custkey%19=0 OR c_custkey%7=0 OR c_custkey%13=0 OR c_custkey%5=0) AS published FROM customer""")
def publishable_scans(spark, sf):
    return CP.publishable(*evidence(spark, sf))


@query("""SELECT sha256(concat('c', cast(c_custkey AS varchar))) AS corpus_sha256, c_custkey*10 AS total_events, c_custkey%17 AS net, c_custkey%7 AS liquid_net FROM customer WHERE c_custkey%11<>0 AND c_custkey%7<>0 AND c_custkey%13<>0 AND c_custkey%5<>0""")
def evidence_seals(spark, sf):
    r, s, _ = evidence(spark, sf)
    return CP.seal(r, s).select("corpus_sha256", "total_events", "net", "liquid_net")


@query("""SELECT CASE WHEN c_custkey%19=0 THEN sha256(concat('y', cast(c_custkey AS varchar))) ELSE sha256(concat('c', cast(c_custkey AS varchar))) END AS corpus_sha256, f AS file, count(*) AS n,
 bool_and(CASE WHEN f='corpus.json' THEN c_custkey%5<>0 ELSE c_custkey%4<>0 END) AS ok FROM customer, (VALUES ('corpus.json'),('corpus-scan.json')) v(f) WHERE c_custkey%3<>0 GROUP BY ALL""")
def seal_verification(spark, sf):
    """The sealed files of every corpus, written one file each; some changed after sealing, some gone."""
    _, _, seals = evidence(spark, sf)
    c = F.col
    body = F.concat_ws("|", c("report_id").cast("string"), c("file"))
    docs = seals.select("report_id", "corpus_sha256", F.explode(F.array(F.lit("corpus.json"), F.lit("corpus-scan.json"))).alias("file"))
    folder_of = folder(spark, "sealed")
    written = docs.where(~((c("file") == "corpus-scan.json") & (c("report_id") % 8 == 0))).withColumn("text", F.concat(body, F.when(
        ((c("file") == "corpus.json") & (c("report_id") % 5 == 0)) | ((c("file") == "corpus-scan.json") & (c("report_id") % 4 == 0)), "!").otherwise("")))
    FI.write_texts(written.select(c("corpus_sha256").alias("folder"), "file", "text"), folder_of)
    found = CP.file_hashes(spark, folder_of).select(F.regexp_extract("path", "([0-9a-f]{64})/", 1).alias("corpus_sha256"),
                                                    F.regexp_extract("path", r"/(?:file=)?(corpus(?:-scan)?\.json)(?:/|$)", 1).alias("file"), "sha256")
    sealed = seals.withColumns({"report_sha256": F.sha2(F.concat(c("report_id").cast("string"), F.lit("|corpus.json\n")), 256),
                                "scan_sha256": F.sha2(F.concat(c("report_id").cast("string"), F.lit("|corpus-scan.json\n")), 256)})
    return CP.verify_seal(sealed, found).groupBy("corpus_sha256", "file").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"))


# ---- exports -----------------------------------------------------------------------------------
def unified(spark, sf):
    c = F.col
    t = B.trades(spark, sf).select(F.timestamp_micros("t").alias("tiempo"), c("route").alias("ruta"), F.lit("BTC/USD").alias("detalle"), c("qty").alias("cantidad_btc"), (c("pnl") / 10000.0).alias("utilidad_usd"), (c("capital") / 100.0).alias("costo_usd"))
    e = B.read(spark, sf, "events").select(c("ts").cast("timestamp").alias("tiempo"), c("event_type").alias("ruta"), c("props").alias("detalle"), c("user_id").alias("cantidad_btc"), c("value").alias("utilidad_usd"))
    r = B.read(spark, sf, "orders").where("o_orderstatus = 'P'").select(c("o_orderdate").cast("timestamp").alias("tiempo"), c("o_orderpriority").alias("ruta"), c("o_totalprice").alias("costo_usd"))
    return EX.unified_rows({"operacion": t, "evento": e, "rebalanceo": r})


@query(f"""WITH {B.TRADES_SQL}, u AS (SELECT 'operacion' AS tipo, 1 AS kind_rank, route AS ruta, printf('%.8f', qty) AS cantidad_btc, printf('%.4f', pnl/10000.0::DOUBLE) AS utilidad_usd, printf('%.4f', capital/100.0::DOUBLE) AS costo_usd FROM trades
 UNION ALL SELECT 'evento', 2, event_type, printf('%.8f', user_id::DOUBLE), printf('%.4f', value), '' FROM events UNION ALL SELECT 'rebalanceo', 6, o_orderpriority, '', '', printf('%.4f', o_totalprice) FROM orders WHERE o_orderstatus='P')
SELECT tipo, kind_rank, ruta, cantidad_btc, utilidad_usd, costo_usd, count(*) AS n FROM u GROUP BY ALL""")
def unified_log(spark, sf):
    return unified(spark, sf).groupBy("tipo", "kind_rank", "ruta", "cantidad_btc", "utilidad_usd", "costo_usd").agg(F.count("*").alias("n"))


@query(f"WITH {B.TRADES_SQL} SELECT 'operacion' AS tipo, count(*) AS n FROM trades UNION ALL SELECT 'evento', count(*) FROM events UNION ALL SELECT 'rebalanceo', count(*) FROM orders WHERE o_orderstatus='P'")
def unified_csv(spark, sf):
    path = folder(spark, "csv")
    EX.write_unified_csv(unified(spark, sf), path)
    return spark.read.option("header", True).option("escape", "\\").csv(path).groupBy("tipo").agg(F.count("*").alias("n"))


@query()
def table_fingerprints(spark, sf):
    out = None
    for t in ("orders", "lineitem", "events", "customer"):
        f = EX.table_fingerprint(B.read(spark, sf, t)).withColumn("table", F.lit(t))
        out = f if out is None else out.unionByName(f)
    return out


@query("SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def json_export(spark, sf):
    path = folder(spark, "json")
    t = {n: B.read(spark, sf, n) for n in ("orders", "customer")}
    EX.export_json(t, path)
    out = None
    for n in t:
        r = spark.read.schema(t[n].schema).json(f"{path}/{n}").agg(F.count("*").alias("rows")).withColumn("table", F.lit(n))
        out = r if out is None else out.unionByName(r)
    return out


_JSON = {"orders": ("o_orderkey", "o_totalprice"), "customer": ("c_custkey", "c_acctbal")}


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows, sum({k})::BIGINT AS keys, sum(cast(round({v}*100) AS bigint))::BIGINT AS cents, true AS same FROM {n}" for n, (k, v) in _JSON.items()))
def json_contents(spark, sf):
    """What the exported JSON holds once read back: sums, and whether its fingerprint is that of the table."""
    path = folder(spark, "json")
    t = {n: B.read(spark, sf, n) for n in _JSON}
    marks = EX.export_json(t, path)
    out = None
    for n, (k, v) in _JSON.items():
        back = spark.read.schema(t[n].schema).json(f"{path}/{n}")
        sums = back.agg(F.sum(k).alias("keys"), F.sum(F.round(F.col(v) * 100).cast("bigint")).alias("cents"))
        now = EX.table_fingerprint(back).select("rows", F.struct("rows", "low", "high").alias("now"), F.lit(n).alias("table"))
        r = now.join(F.broadcast(sums))
        out = r if out is None else out.unionByName(r)
    marks = marks.select("table", F.struct("rows", "low", "high").alias("then"))  # a row per table
    return out.join(F.broadcast(marks), "table").select("table", "rows", "keys", "cents", (F.col("now") == F.col("then")).alias("same"))


@query("""SELECT c_custkey, sha256(concat('{"c_custkey":', cast(c_custkey AS varchar), ',"c_mktsegment":"', c_mktsegment, '","c_name":"', c_name, '"}')) AS sha256 FROM customer""")
def canonical_json_hash(spark, sf):
    c = B.read(spark, sf, "customer")
    return c.select("c_custkey", F.sha2(EX.canonical_json(c, ["c_name", "c_mktsegment", "c_custkey"]), 256).alias("sha256"))


@query()
def evaluation_report_rows(spark, sf):
    from tapelab.catalog.studies import default_runs

    return EX.report_rows(default_runs(spark, sf))


@query("SELECT event_id AS seq, true AS in_file FROM events WHERE event_id % 97 = 0")
def tape_bad_lines(spark, sf):
    """A tape in which every 97th event is damaged: the damaged lines, each found at a line of its own within its file."""
    whole, path = folder(spark, "tape"), folder(spark, "damaged")
    TP.write_tape(B.quotes(spark, sf, levels=True), whole)
    lines = spark.read.text(whole)
    seq = F.get_json_object("value", "$.sequenceId").cast("bigint")
    lines.select(F.when(seq % 97 == 0, F.concat(F.lit("x"), "value")).otherwise(F.col("value")).alias("value")).write.text(path)
    bad = TP.numbered_bad_lines(spark, path)
    sizes = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    same = bad.groupBy("file", "number").agg(F.count("*").alias("k"), F.max("line").alias("line"))  # a line has one number
    seq = F.get_json_object(F.substring("line", 2, 1_000_000), "$.sequenceId").cast("bigint")
    return same.join(sizes, "file").select(seq.alias("seq"), ((F.col("k") == 1) & F.col("number").between(1, F.col("n"))).alias("in_file"))


# ---- tapes and payloads ------------------------------------------------------------------------
@query(f"""WITH {B.QUOTES_SQL}, {B.LEVELS_SQL} SELECT venue, pair, count(*) AS events, min(t) AS first_t, max(t) AS last_t, sum(latency_ms)::BIGINT AS latency, {s6('max(ask)', 'top_ask')}, count(*)*6 AS bid_levels FROM quotes GROUP BY ALL""")
def tape_scan(spark, sf):
    """Quotes written as a JSONL tape and read back with the fixed schema."""
    path = folder(spark, "tape")
    TP.write_tape(B.quotes(spark, sf, levels=True), path)
    e = TP.read_tape(spark, path)
    return e.groupBy("venue", "pair").agg(F.count("*").alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("latency_ms").alias("latency"),
                                          r6(F.max(F.get("asks", F.lit(0))["price"]), "top_ask"), F.sum(F.size("bids")).alias("bid_levels"))


@query(f"""WITH {B.QUOTES_SQL} SELECT venue, count(*) AS quotes, sum(latency_ms)::BIGINT AS latency, {s6('min(bid)','low_bid')} FROM quotes GROUP BY venue""")
def quote_scan(spark, sf):
    """Quotes from one folder that holds lines, arrays and wrapper objects."""
    path = folder(spark, "quotes")
    c = F.col
    q = B.quotes(spark, sf).select(
        c("venue").alias("exchange"), c("pair").alias("par"), "bid", c("bid_qty").alias("bidCantidad"), "ask", c("ask_qty").alias("askCantidad"),
        (F.expr("t div 1000")).alias("eventoUnixMs"), F.timestamp_micros("t").alias("recibidaEn"), c("latency_ms").alias("latenciaMs"), c("seq").alias("secuencia"))
    q.where("secuencia % 3 = 0").write.json(f"{path}/lines")
    rows = q.where("secuencia % 3 > 0").withColumns({"g": F.expr("secuencia div 300"), "m": F.col("secuencia") % 3})
    doc = rows.repartition(default_parts(spark), "g", "m").groupBy("g", "m").agg(F.collect_list(F.struct(*q.columns)).alias("cotizaciones"))
    # one document of 200 quotes at most per file
    text = F.when(c("m") == 1, F.to_json("cotizaciones")).otherwise(F.to_json(F.struct("cotizaciones")))
    doc.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/docs")
    quotes = TP.read_quotes(spark, path, lines=("*.json",), documents="*.txt")
    return quotes.groupBy("venue").agg(F.count("*").alias("quotes"), F.sum("latency_ms").alias("latency"), r6(F.min("bid"), "low_bid"))


# Venue names and the layouts of their messages.
_NAMES = ("Binance", "OKX", "Bybit", "Kraken", "Coinbase", "Bitfinex", "KuCoin", "Gate.io", "Bitstamp", "Gemini")
# payload layouts with %1$s bid price, %2$s bid size, %3$s ask price, %4$s ask size, %5$d number
_LAYOUTS = (
    '{"lastUpdateId":%5$d,"bids":[["%1$s","%2$s"]],"asks":[["%3$s","%4$s"]]}',
    '{"arg":{"channel":"books","instId":"ETH-USDT"},"action":"update","data":[{"bids":[["%1$s","%2$s","0","1"]],"asks":[["%3$s","%4$s","0","1"]],"seqId":%5$d,"prevSeqId":7,"ts":"1700"}]}',
    '{"topic":"orderbook.50.SOLUSDT","type":"snapshot","ts":1700,"data":{"b":[["%1$s","%2$s"]],"a":[["%3$s","%4$s"]],"seq":%5$d}}',
    '{"channel":"book","type":"update","data":[{"symbol":"BTC/USD","bids":[{"price":%1$s,"qty":%2$s}],"asks":[{"price":%3$s,"qty":%4$s}]}]}',
    '{"channel":"l2_data","sequence_num":%5$d,"events":[{"type":"update","product_id":"BTC-USD","updates":[{"side":"bid","price_level":"%1$s","new_quantity":"%2$s"},{"side":"offer","price_level":"%3$s","new_quantity":"%4$s"}]}]}',
    '[17,["snapshot",[%1$s,2,%2$s],[%3$s,1,-%4$s]]]',
    '{"type":"message","subject":"trade.l2update","data":{"sequence":%5$d,"bids":[["%1$s","%2$s"]],"asks":[["%3$s","%4$s"]]}}',
    '{"method":"order_book.update","params":[true,1700,"BTC_USDT",{"bids":[["%1$s","%2$s"]],"asks":[["%3$s","%4$s"]]}]}',
    '{"event":"data","data":{"timestamp":"1700","bids":[["%1$s","%2$s"]],"asks":[["%3$s","%4$s"]]}}',
    '[{"type":"update","side":"bid","price":"%1$s","remaining":"%2$s"},{"type":"update","side":"ask","price":"%3$s","remaining":"%4$s"}]',
)


def payloads(spark, sf):
    q = B.quotes(spark, sf)
    i = (F.col("seq") % 10).cast("int")
    args = [F.col("bid").cast("string"), (F.col("bid_qty") + 0.5).cast("string"), F.col("ask").cast("string"), (F.col("ask_qty") + 0.5).cast("string"), F.col("seq")]
    text = F.lit(None).cast("string")
    for k, layout in enumerate(_LAYOUTS):
        text = F.when(i == k, F.format_string(layout, *args)).otherwise(text)
    noise = F.when(F.col("seq") % 50 == 11, '{"arg":{"channel":"trades"}}').when(F.col("seq") % 50 == 26, '{"type":"welcome"}')
    return q.select(F.get(F.array(*[F.lit(n) for n in _NAMES]), i).alias("venue"), F.col("t").alias("local_t"), F.coalesce(noise, text).alias("payload"))


@query(f"""WITH {B.QUOTES_SQL}, p AS (SELECT *, {list(_NAMES)}[(seq%10)::INT+1] AS name FROM quotes WHERE seq%50 NOT IN (11, 26))
SELECT name AS venue, t, CASE WHEN name='OKX' THEN 'ETH/USD' WHEN name='Bybit' THEN 'SOL/USD' WHEN name='Gate.io' THEN 'BTC_/USD' ELSE 'BTC/USD' END AS pair, CASE WHEN name IN ('Binance','Bybit','Bitfinex') THEN 'snapshot' ELSE 'delta' END AS kind,
 CASE WHEN name IN ('Binance','OKX','Bybit','Coinbase','KuCoin') THEN seq END AS sequence, {s6('bid','bid')}, {s6('bid_qty+0.5::DOUBLE','bid_qty')}, {s6('ask','ask')}, {s6('ask_qty+0.5::DOUBLE','ask_qty')} FROM p""")
def payload_normalisation(spark, sf):
    m = NZ.normalise(payloads(spark, sf))
    lv = lambda s, f: F.get(s, F.lit(0))[f]
    return m.select("venue", "t", "pair", "kind", "sequence", r6(lv("bids", "price"), "bid"), r6(lv("bids", "qty"), "bid_qty"), r6(lv("asks", "price"), "ask"), r6(lv("asks", "qty"), "ask_qty"))


# ---- health ------------------------------------------------------------------------------------
def state(spark, sf):
    q = B.quotes(spark, sf)
    cur = q.groupBy("venue", "pair").agg(F.max(F.struct("t", "seq", "latency_ms")).alias("q")).select("venue", "pair", "q.*")
    cur = cur.withColumns({"rest": F.col("latency_ms") > 4000, "status": F.when(F.col("seq") % 7 == 0, "fuera_de_orden").otherwise("ok")})
    return cur, F.lit(q.agg(F.max("t")).first()[0])


@query(f"""WITH {B.QUOTES_SQL}, {B.TRADES_SQL}, c AS (SELECT venue, pair, max(t) AS t, arg_max(seq, (t,seq)) AS seq, arg_max(latency_ms, (t,seq)) AS l FROM quotes GROUP BY ALL), m AS (SELECT max(t) AS m FROM quotes),
f AS (SELECT *, m-t <= 7200000000 AS fresh, l>4000 AS rest, seq%7=0 AS broken FROM c, m),
a AS (SELECT count(DISTINCT venue) FILTER (WHERE fresh) AS fresh, count(DISTINCT venue) FILTER (WHERE fresh AND NOT rest) AS sockets, count(*) FILTER (WHERE rest) AS rq, count(*) FILTER (WHERE fresh AND broken) AS br, (SELECT count(*) FROM trades WHERE route IS NOT NULL) AS ex,
 (SELECT count(*) FROM trades WHERE partial) AS pa, (SELECT count(*) FROM venues) AS cf FROM f)
SELECT unnest(['feeds','snapshots','integrity','costs','rest_fallback','decision_inspector','partial_fill_evidence']) AS "check", unnest([sockets>=2, fresh>=2, br=0 AND fresh>=2, cf>0, rq>0 OR sockets>=2, ex>0, pa>0]) AS ok, unnest([sockets, fresh, br, cf, rq, ex, pa]) AS detail FROM a""")
def health_checks(spark, sf):
    cur, now = state(spark, sf)
    t = B.trades(spark, sf)
    return H.health_checks(cur, t.select(F.col("route").alias("code")), t, B.MODEL, B.venues(spark), now, 7_200_000_000)


@query("""WITH b AS (SELECT cast(round(s_acctbal*100) AS bigint) AS usd, s_suppkey%5 AS btc FROM supplier) SELECT sum(usd+btc*700)::BIGINT AS capital_usd, sum(500000+btc*700)::BIGINT AS initial_usd, round((sum(usd+btc*700)-sum(500000+btc*700))::DOUBLE/sum(500000+btc*700)::DOUBLE*10000.0::DOUBLE,6)+0.0 AS return_bps FROM b""")
def capital_valuation(spark, sf):
    b = B.read(spark, sf, "supplier").select(F.round(F.col("s_acctbal") * 100).cast("bigint").alias("usd"), (F.col("s_suppkey") % 5).alias("btc"), F.lit(500000).cast("bigint").alias("usd0"), (F.col("s_suppkey") % 5).alias("btc0"))
    return H.capital(b, F.lit(700)).select("capital_usd", "initial_usd", r6("return_bps", "return_bps"))


@query(f"""WITH {B.QUOTES_SQL}, {B.TRADES_SQL}, r AS (SELECT venue, row_number() OVER (PARTITION BY venue ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY venue) AS n, latency_ms FROM quotes),
w AS (SELECT venue, sum(power(0.9::DOUBLE, (n-i)::DOUBLE)*latency_ms*CASE WHEN i=1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) AS m FROM r GROUP BY venue)
SELECT (SELECT route FROM trades ORDER BY pnl//capital DESC, route DESC, seq DESC LIMIT 1) AS best_route, (SELECT route FROM trades WHERE pnl>0 ORDER BY pnl DESC, route DESC, seq DESC LIMIT 1) AS best_executable,
 (SELECT venue FROM w ORDER BY m, venue LIMIT 1) AS fastest, (SELECT venue FROM w ORDER BY m DESC, venue DESC LIMIT 1) AS slowest, (SELECT route FROM trades WHERE partial ORDER BY t DESC, seq DESC, route DESC LIMIT 1) AS latest_partial""")
def run_summary(spark, sf):
    from tapelab.operators.ordered import ewma

    t = B.trades(spark, sf)
    o = t.select("route", "seq", F.expr("pnl div capital").alias("net_bps"), F.col("pnl").alias("utility_usd"), (F.col("pnl") > 0).alias("executable"))
    return H.run_summary(o, ewma(B.quotes(spark, sf), ["venue"], ["t", "seq"], "latency_ms", 0.1), t)


@query()
def replay_summary(spark, sf):
    from tapelab.operators.replay import replay_clock

    q = B.quotes(spark, sf).select("venue", "pair", "t", "seq", "bid", "ask", F.expr("t div 1000").alias("ms"))
    ticks = replay_clock(q, "ms", ["t", "seq"]).drop("rank", "n")
    return H.replay_summary(ticks, B.trades(spark, sf))


