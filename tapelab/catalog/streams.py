"""Streaming jobs run to the end over a tape cut into files, compared with the batch answer."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab import bindings as B
from tapelab.catalog.base import query, r6, s6
from tapelab.catalog.routes import _seq_sql, numbered
from tapelab.catalog.scan import _funnel_cols, cands_sql
from tapelab.operators.funnel import scan_funnel
from tapelab.operators.ordered import BUCKET, Cuts, bucketed
from tapelab.plans.corpus import recorded_order
from tapelab.sources import audit_log as AL
from tapelab.sources.tape import file_hashes, publish_in_order, read_capture_configs, read_corpus, write_tape
from tapelab.session import stage, staging_dir
from tapelab.streaming import capture, detect, history, quotes, signals, sink

S = replace(B.MODEL, slippage_fallback="zero")
SLICES = 3
SLICE_ROWS = 1_000_000


def work(spark, name):
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def slices(rows):
    """``rows`` with ``file``: files of a bounded number of rows in ``seq`` order, cut by rank, not by what the numbers are; and their number."""
    k = max(SLICES, rows.count() // SLICE_ROWS)
    cuts = rows.agg(F.percentile_approx("seq", [i / k for i in range(1, k)], 10_000)).first()[0] or []
    placed = bucketed(rows.where(F.col("seq").isNotNull()) if cuts else rows, ["seq"], cuts=Cuts(tuple(cuts), (None,) * len(cuts)))
    return placed.withColumnRenamed(BUCKET, "file"), k


def write_slices(rows, path, write):
    """The slices of ``rows`` as files under ``path``, all by one job: a task writes a slice, a slice is one file."""
    spark = rows.sparkSession
    rows, k = slices(rows)
    write(rows.repartitionById(k, "file"), f"{path}/_work")
    publish_in_order(spark, f"{path}/_work", path)


def tape(spark, sf):
    """The quotes as JSONL files in time order, so that every file is one micro-batch."""
    path = work(spark, "stream-in")
    write_slices(B.quotes(spark, sf, levels=True), path, lambda rows, to: write_tape(rows, to, by="file"))
    return path


def table_stream(spark, sf, name):
    """A given table as a stream: its file is the only one that the folder source sees."""
    return spark.readStream.schema(B.read(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def events(spark, sf):
    return quotes.top_of_book(quotes.replay(spark, tape(spark, sf)))


@query(f"""WITH {B.QUOTES_SQL} SELECT venue, pair, max(t) AS t, arg_max(seq, (t,seq)) AS seq, {s6('arg_max(bid, (t,seq))','bid')}, {s6('arg_max(ask, (t,seq))','ask')}, count(*) AS ingested FROM quotes GROUP BY ALL""")
def stream_latest_quotes(spark, sf):
    path = work(spark, "latest")
    sink.upsert_sink(quotes.latest_quotes(events(spark, sf)), path, work(spark, "cp"))
    return sink.upserted(spark, path, ["venue", "pair"]).select("venue", "pair", "t", "seq", r6("bid", "bid"), r6("ask", "ask"), "ingested")


@query(f"{cands_sql()} SELECT {_funnel_cols} FROM cands")
def stream_detection_funnel(spark, sf):
    out = work(spark, "detected")
    detect.detect(events(spark, sf), B.venues(spark), S, B.STALE_US, out, work(spark, "cp"), work(spark, "state"), sorted(B.VENUE_BIND))
    return scan_funnel(spark.read.parquet(out)).select("events", "comparable", "gross", "net", "liquid_net")


@query(_seq_sql("num > last+1", "num <= last", "num IS NULL", "secuencia_continua"))
def stream_sequence_policy(spark, sf):
    path = work(spark, "numbered")
    rows = numbered(spark, sf)
    write_slices(rows, path, lambda placed, to: placed.write.partitionBy("file").parquet(to))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    good, late = work(spark, "good"), work(spark, "late")
    quotes.checked_sequences(stream, "exact", good, late, work(spark, "cp"), work(spark, "state"))
    return spark.read.parquet(good).select("seq", "status").unionByName(spark.read.parquet(late).select("seq", "status"))


@query(f"""WITH {B.QUOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY venue) AS n FROM quotes)
SELECT venue, max(n) AS n, {s6('sum(power(0.9::DOUBLE, (n-i)::DOUBLE) * latency_ms * CASE WHEN i=1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)', 'ewma')} FROM r GROUP BY venue""")
def stream_latency_ewma(spark, sf):
    state = work(spark, "state")
    quotes.latency_ewma(events(spark, sf), work(spark, "cp"), state)
    rows = spark.read.parquet(state)
    top = rows.agg(F.max("v").alias("_v"))
    return rows.join(F.broadcast(top), F.col("v") == F.col("_v")).select("venue", "n", r6("ewma", "ewma"))


@query("SELECT year(d)::INT AS year, count(*) AS rows FROM (SELECT min(o_orderdate) AS d FROM orders GROUP BY o_orderkey // 4) GROUP BY 1")
def stream_audit_sink(spark, sf):
    """The orders as a log stream, read twice with new checkpoints: nothing is written twice."""
    path = work(spark, "log")
    for _ in range(2):
        o = table_stream(spark, sf, "orders")
        rows = AL.log_rows(o, "operacion", F.expr("o_orderkey div 4"), F.date_trunc("year", F.col("o_orderdate").cast("timestamp")))
        sink.audit_sink(rows, path, work(spark, "cp"))
    return AL.read_log(spark, path).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("rows"))


_STEP = 10 * 86_400_000_000


@query(f"""WITH {B.TRADES_SQL}, w AS (SELECT ((t // {_STEP}) + k + 1) * {_STEP} AS at_us, pnl FROM trades, range(3) r(k)) SELECT at_us, sum(pnl)::BIGINT AS recent, sum(pnl) < -1000000000 AS breaker FROM w GROUP BY at_us""")
def stream_loss_breaker(spark, sf):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    edge = F.round(F.col("l_discount") * 100).cast("bigint") - F.round(F.col("l_tax") * 100).cast("bigint") - 2
    t = table_stream(spark, sf, "lineitem").where("l_suppkey % 5 <> l_partkey % 5")
    t = t.select(F.col("l_shipdate").cast("timestamp").alias("ts"), (cents * edge).alias("pnl"))
    out = signals.loss_breaker(t, B.MODEL, limit=1_000_000_000, length="30 days", step="10 days")
    path = work(spark, "breaker")
    sink.upsert_sink(out, path, work(spark, "cp"))
    return sink.upserted(spark, path, ["at"]).select(F.unix_micros("at").alias("at_us"), "recent", "breaker")


@query(f"""WITH {B.QUOTES_SQL}, w AS (SELECT pair, ((t // 3600000000) + k + 1) * 3600000000 AS at_us, (bid+ask)/2.0::DOUBLE AS mid FROM quotes, range(3) r(k)) SELECT pair, at_us, {s6('(max(mid)-min(mid))/min(mid)*10000.0::DOUBLE','range_bps')} FROM w GROUP BY ALL""")
def stream_volatility(spark, sf):
    out = signals.volatility(events(spark, sf), B.MODEL, length="3 hours", step="1 hour")
    path = work(spark, "volatility")
    sink.upsert_sink(out, path, work(spark, "cp"))
    return sink.upserted(spark, path, ["pair", "at"]).select("pair", F.unix_micros("at").alias("at_us"), r6("range_bps", "range_bps"))


@query(f"WITH {B.QUOTES_SQL} SELECT strftime(make_timestamp(t//86400000000*86400000000), '%Y%m%d-%H%M') AS shard, count(*) AS events FROM quotes GROUP BY 1")
def stream_shards(spark, sf):
    path = work(spark, "shards")
    sink.shard_sink(quotes.replay(spark, tape(spark, sf)), path, work(spark, "cp"), minutes=1440)
    return spark.read.json(path, schema="venue string, shard string").groupBy("shard").agg(F.count("*").alias("events"))


def captured(spark, sf):
    """The quotes recorded as shards of a day at most."""
    path = work(spark, "corpus")
    capture.capture(quotes.replay(spark, tape(spark, sf)), path, work(spark, "cp"), minutes=1440)
    return path


@query(f"""WITH {B.QUOTES_SQL} SELECT t//86400000000*86400000000 AS day, count(*) AS events, count(*) AS snapshots, true AS hashes_match, true AS bytes_match, true AS numbered, true AS configured FROM quotes GROUP BY 1""")
def stream_capture(spark, sf):
    """Manifests of the recorded shards against their files, by day; shards are numbered without a gap."""
    root = captured(spark, sf)
    manifests, _ = read_corpus(spark, root)
    c = F.col
    files = file_hashes(spark, f"{root}/*/events.jsonl").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("shard"), c("bytes").alias("size"), c("sha256").alias("now"))
    configs = read_capture_configs(spark, root).select("shard", c("exchanges").alias("asked"), "depth")
    rows = manifests.join(files, "shard").join(configs, "shard", "left").withColumn("number", F.regexp_extract("shard", "^shard-([0-9]+)-", 1).cast("bigint"))
    whole = rows.agg((F.count_distinct("number") == F.max("number") + 1).alias("numbered"))  # one row
    day = F.unix_micros("startedAt") - F.pmod(F.unix_micros("startedAt"), F.lit(86_400_000_000))
    return rows.groupBy(day.alias("day")).agg(
        F.sum("events").alias("events"), F.sum("snapshots").alias("snapshots"), F.bool_and(c("sha256") == c("now")).alias("hashes_match"),
        F.bool_and(c("uncompressedBytes") == c("size")).alias("bytes_match"),
        F.bool_and(F.coalesce((c("asked") == c("exchanges")) & (c("depth") == 10), F.lit(False))).alias("configured")).join(F.broadcast(whole))


@query(f"""WITH {B.QUOTES_SQL} SELECT venue, pair, count(*) AS events, min(t) AS first_t, max(t) AS last_t, {s6('sum(bid)', 'bids')}, true AS in_order FROM quotes GROUP BY ALL""")
def corpus_events(spark, sf):
    """Events of all shards of a corpus on disk in one recorded order, which follows time."""
    _, rows = read_corpus(spark, captured(spark, sf))
    rows = stage(quotes.top_of_book(rows).select("shard", "block_start", "row_id", "venue", "pair", "t", "sequence", "bid"))  # lines are parsed once
    rows = recorded_order(rows.withColumn("at", F.struct("t", "sequence")))
    order = rows.groupBy("shard").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.min("at").alias("x"), F.max("at").alias("y"))
    # shards follow each other in number and time; a row per shard is ordered
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    order = order.select(((F.max("b").over(earlier) < F.col("a")) & (F.max("y").over(earlier) <= F.col("x"))).alias("follows"))
    ends = order.agg(F.coalesce(F.bool_and("follows"), F.lit(True)).alias("in_order"))
    return rows.groupBy("venue", "pair").agg(
        F.count("*").alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), r6(F.sum("bid"), "bids")).join(F.broadcast(ends))


@query(f"WITH {B.QUOTES_SQL} SELECT venue, count(*) AS events FROM quotes, (SELECT max(t) AS m FROM quotes) WHERE t >= m - 3600000000 GROUP BY venue")
def stream_recent_history(spark, sf):
    path = work(spark, "history")
    quotes.retained_history(quotes.replay(spark, tape(spark, sf)), path, work(spark, "cp"), unit="yyyy-MM-dd")
    return quotes.recent(spark, path, unit="yyyy-MM-dd").groupBy("venue").agg(F.count("*").alias("events"))




_KEEP = 24 * 60  # minutes; the table has a few messages an hour
_CELL = 6 * 3600


@query(f"""WITH {B.QUOTES_SQL}, c AS (SELECT venue, pair, t//1000//{_CELL * 1000} AS cell FROM quotes), w AS (SELECT max(t)//1000 - 60000 AS mark FROM quotes)
SELECT venue, pair, (cell+1)*{_CELL * 1000} + {_KEEP * 60_000} < mark AS forgotten, count(*) AS rows, min(cell) AS first_cell, max(cell) AS last_cell FROM c, w GROUP BY ALL""")
def stream_expiry(spark, sf):
    """Messages forgotten by the state of the last day, and those still in it."""
    out, cp = work(spark, "forgotten"), work(spark, "cp")
    rows = events(spark, sf).withWatermark("ts", "1 minute")
    with history.with_state_store(spark):
        history.to_table(history.rolling_state(rows, _KEEP, _CELL), out, cp)
    gone = spark.read.parquet(out).select("venue", "pair", "cell", "rows", F.lit(True).alias("forgotten"))
    kept = history.retained(spark, cp).groupBy("venue", "pair", "cell").agg(F.count("*").alias("rows")).withColumn("forgotten", F.lit(False))
    return gone.unionByName(kept).groupBy("venue", "pair", "forgotten").agg(
        F.sum("rows").alias("rows"), F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"))


@query(f"""WITH {B.QUOTES_SQL}, w AS (SELECT max(t)//1000 - 60000 AS mark FROM quotes), g AS (SELECT venue, pair, t, lead(t) OVER (PARTITION BY venue, pair ORDER BY t, seq) AS nxt FROM quotes)
SELECT venue, pair, t AS last_seen, nxt - t AS silent_us FROM g, w WHERE nxt - t > {B.STALE_US} OR (nxt IS NULL AND (t + {B.STALE_US})//1000 + 1 < mark)""")
def stream_silence(spark, sf):
    """Silences of every market, the open ones with a null length."""
    out = work(spark, "silent")
    rows = events(spark, sf).withWatermark("ts", "1 minute")
    with history.with_state_store(spark):
        history.to_table(history.silences(rows, B.STALE_US), out, work(spark, "cp"))
    return history.last_word(spark.read.parquet(out))
