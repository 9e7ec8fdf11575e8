"""Corpus verification, roll-up, evidence gates, overlaps, scan and seal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelab.config import CostModel
from tapelab.functions.quality import level_violations
from tapelab.operators.book import order_failures, rebuild_books, snapshot_books
from tapelab.operators.funnel import candidates, scan_funnel, scan_rejects
from tapelab.sources.tape import file_hashes, read_corpus
from tapelab.session import small, stage

# Gates of the evidence report.
MIN_SHARDS, PRELIMINARY, MILLION = 10, 100_000, 1_000_000
DAY_MS, EVENT_EVERY_MS, MAX_GAP_RATE = 86_400_000, 5_000, 0.01
LOSS_POLICY = "bounded_channel_await_no_application_drop"
CLASSES = {"public_market_capture": "public_market_capture_corpus", "synthetic_benchmark": "synthetic_benchmark_corpus"}
COUNTS = ("events", "snapshots", "gaps", "rest", "reconnects")


def derive_manifests(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What a manifest should say, counted from the events of every shard.

    Two grouped passes with partial sums; the venue map comes from the small per-venue counts.
    """
    keys = keys or ["shard"]
    per = events.groupBy(*keys, "venue").agg(
        F.count("*").alias("events"), F.count_if("snapshot").alias("snapshots"), F.count_if("gap").alias("gaps"),
        F.count_if("rest").alias("rest"), F.count_if("reconnected").alias("reconnects"), F.sum("bytes").alias("bytes"),
        F.min("t").alias("started"), F.max("t").alias("ended"), F.collect_set("pair").alias("pairs"))
    entry = F.struct("venue", "events")
    return per.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "bytes")], F.min("started").alias("started"), F.max("ended").alias("ended"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_venue"),
        F.array_sort(F.collect_set("venue")).alias("venues"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("pairs")))).alias("pairs"),
    ).withColumn("duration_ms", F.floor((F.col("ended") - F.col("started")) / 1000))


def reconcile(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """Shards whose declared manifest disagrees with the events, with the reasons."""
    d = declared.select("shard", *[F.col(c).alias(f"d_{c}") for c in (*COUNTS, "bytes", "started", "ended", "by_venue")])
    j = actual.withColumn("_a", F.lit(True)).join(d.withColumn("_d", F.lit(True)), "shard", "full")
    c = F.col
    counts = F.lit(False)
    for x in COUNTS:
        counts = counts | (c(x) != c(f"d_{x}"))
    same_map = F.array_sort(F.map_entries("by_venue")) == F.array_sort(F.map_entries("d_by_venue"))
    why = F.array_compact(F.array(
        F.when(c("_a").isNull(), F.lit("no_events")), F.when(c("_d").isNull(), F.lit("no_manifest")),
        F.when(counts, F.lit("counts")), F.when((F.size("d_by_venue") > 0) & ~same_map, F.lit("venue_counts")),
        F.when((c("d_bytes") > 0) & (c("bytes") != c("d_bytes")), F.lit("bytes")),
        F.when((c("ended") < c("d_started")) | (c("ended") > c("d_ended")), F.lit("window"))))
    return j.select("shard", F.explode(why).alias("reason"))


def overlaps(shards: DataFrame) -> DataFrame:
    """Shards that start before an earlier shard of the same venue and pair has ended.

    Sorted by start, a shard overlaps some earlier one exactly when it starts before the latest end
    so far; that running maximum is linear, where a self-join would form all pairs. Touching is
    fine. Input: shard, started, ended, venues, pairs, sha256.
    """
    m = shards.where("started < ended").withColumn("venue", F.explode("venues")).withColumn("pair", F.explode("pairs"))
    w = W.partitionBy("venue", "pair").orderBy("started", "sha256").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("_open", F.max(F.struct("ended", "shard")).over(w))
    hit = m.where(F.col("started") < F.col("_open.ended"))
    return hit.select("shard", F.col("_open.shard").alias("with_shard"), "venue", "pair")


def duplicate_shards(shards: DataFrame, key: str = "sha256") -> DataFrame:
    """Content hashes that occur more than once."""
    return shards.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def corpus_hash(df: DataFrame, order: list[str]) -> Column:
    """SHA-256 over the shard hashes in order, one per line (shards, not events, are collected)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("sha256").alias("_h")))), lambda x: x["_h"])
    return F.sha2(F.concat(F.array_join(ordered, "\n"), F.lit("\n")), 256)


def rollup(shards: DataFrame) -> DataFrame:
    """One row per corpus: totals, span, captured time, sets and provenance."""
    c = F.col
    return shards.agg(
        F.count("*").alias("shards"), *[F.sum(x).alias(x) for x in (*COUNTS, "bytes", "duration_ms")],
        F.min("started").alias("earliest"), F.max("ended").alias("latest"),
        F.floor((F.max("ended") - F.min("started")) / 1000).alias("span_ms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("venues")))).alias("venues"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pairs")))).alias("pairs"),
        F.array_sort(F.collect_set("commit")).alias("commits"), F.bool_and(c("policy") == LOSS_POLICY).alias("loss_accounted"),
        F.bool_and(~c("dirty")).alias("clean"), F.count_distinct("classification").alias("classes"),
        F.min("classification").alias("classification"), corpus_hash(shards, ["started"]).alias("corpus_sha256"))


def venue_counts(shards: DataFrame) -> DataFrame:
    return shards.select(F.explode("by_venue").alias("venue", "events")).groupBy("venue").agg(F.sum("events").alias("events"))


def gates(shards: DataFrame) -> DataFrame:
    """Evidence gates and the publication status of a corpus."""
    r = rollup(shards)
    per = venue_counts(shards).agg(F.collect_list(F.struct("venue", "events")).alias("_v"))
    r = r.join(F.broadcast(per))  # one row each
    c = F.col
    need = F.greatest(F.floor(F.greatest("duration_ms", F.lit(0)) / EVENT_EVERY_MS), F.lit(2))
    covered = F.forall("venues", lambda v: F.exists("_v", lambda x: (x["venue"] == v) & (x["events"] >= need)))
    commit = (F.size("commits") == 1) & F.get("commits", F.lit(0)).rlike("^[0-9a-fA-F]{40}$")
    r = r.select(
        "shards", "events", (F.size("_v") >= 2).alias("multi_venue"), ((F.size("venues") >= 2) & covered).alias("venue_coverage"),
        need.alias("events_needed"), (c("shards") >= MIN_SHARDS).alias("ten_shards"), (c("events") >= PRELIMINARY).alias("preliminary_100k"),
        (c("events") >= MILLION).alias("million_events"), (c("duration_ms") >= DAY_MS).alias("full_day"), "loss_accounted",
        (c("gaps") / F.greatest("events", F.lit(1)) <= MAX_GAP_RATE).alias("gap_rate_ok"), "clean", commit.alias("single_commit"), "classification")
    met = F.lit(True)
    for g in ("multi_venue", "venue_coverage", "ten_shards", "million_events", "full_day", "loss_accounted", "gap_rate_ok", "clean", "single_commit"):
        met = met & c(g)
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), c("classification")), F.lit("unsupported_corpus"))
    status = F.when(kind != CLASSES["public_market_capture"], "synthetic_only").when(met, "scale_verified").otherwise("insufficient_scale")
    return r.withColumns({"corpus_class": kind, "status": status}).withColumn("publishable", F.col("status") == "scale_verified").drop("classification")


def event_flags(events: DataFrame) -> DataFrame:
    """Tape events with the flags the manifest counts."""
    return events.withColumns({"snapshot": F.col("kind") == "snapshot", "rest": F.col("source") == "rest", "bytes": F.lit(0).cast("bigint")})


def manifest_shards(manifests: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Manifests under the names used by the roll-up."""
    c = F.col
    return manifests.select(
        "shard", "events", "snapshots", c("sequenceGaps").alias("gaps"), c("restFallbackEvents").alias("rest"), c("reconnectEvents").alias("reconnects"),
        c("uncompressedBytes").alias("bytes"), F.unix_micros("startedAt").alias("started"), F.unix_micros("endedAt").alias("ended"),
        F.coalesce("eventsByExchange", F.create_map().cast("map<string,bigint>")).alias("by_venue"), c("exchanges").alias("venues"), "pairs",
        F.greatest(F.unix_millis("endedAt") - F.unix_millis("startedAt"), F.lit(0)).alias("duration_ms"), "sha256",
        c("gitCommit").alias("commit"), c("gitDirty").alias("dirty"), c("deliveryPolicy").alias("policy"),
        c("sourceClassification").alias("classification"), c("schemaVersion").alias("version"), c("configSha256").alias("config_sha256"),
        F.when(c("datasetId") == "", F.concat(F.lit("legacy-"), F.substring("sha256", 1, 12))).otherwise(c("datasetId")).alias("dataset_id"))


def verify_tape(events: DataFrame) -> DataFrame:
    """Every violation in the events of shards: (shard, row_id, failure)."""
    line = ["block_start", "row_id"]
    bad = events.select("shard", "row_id", F.explode(level_violations()).alias("failure"))
    ver = events.where("schema_version <> 1").select("shard", "row_id", F.lit("schema_version").alias("failure"))
    order = order_failures(events.withColumn("venue", F.concat_ws("|", "shard", "venue")), line).select("shard", "row_id", "failure")
    return bad.unionByName(ver).unionByName(order)


def verify_corpus(spark: SparkSession, root: str, allowed=("public_market_capture",)) -> dict[str, DataFrame]:
    """Checks of a corpus on disk: problems, shards, rollup, gates. No problem row = verified."""
    manifests, events = read_corpus(spark, root)
    shards = stage(manifest_shards(manifests))
    events = stage(event_flags(events))
    # byte counts of shards come from the files
    files = file_hashes(spark, f"{root}/*/events.jsonl").withColumn("shard", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    files = files.select("shard", F.col("bytes").alias("file_bytes"), F.col("sha256").alias("file_sha"))
    actual = derive_manifests(events).drop("bytes").join(files.select("shard", F.col("file_bytes").alias("bytes")), "shard", "left")
    config = file_hashes(spark, f"{root}/*/capture-config.json").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("shard"), F.col("sha256").alias("config_file"))
    hashed = shards.join(files, "shard", "left").join(config, "shard", "left")
    why = F.array_compact(F.array(
        F.when(F.col("version") != 1, F.lit("schema_version")), F.when(~F.coalesce(F.col("file_sha") == F.col("sha256"), F.lit(False)), F.lit("sha256")),
        F.when(~F.coalesce(F.col("config_file") == F.col("config_sha256"), F.lit(False)), F.lit("config_sha256")),
        F.when(~F.col("classification").isin(*allowed), F.lit("classification"))))
    problems = reconcile(actual, shards).unionByName(hashed.select("shard", F.explode(why).alias("reason")))
    problems = problems.unionByName(verify_tape(events).select("shard", F.col("failure").alias("reason")).distinct())
    problems = problems.unionByName(overlaps(shards).select("shard", F.lit("overlap").alias("reason")).distinct())
    problems = problems.unionByName(shards.join(duplicate_shards(shards), "sha256", "left_semi").select("shard", F.lit("duplicate").alias("reason")))
    return {"problems": problems, "shards": shards, "rollup": rollup(shards), "gates": gates(shards), "events": events}


def scan_corpus(spark: SparkSession, root: str, venues: DataFrame, model: CostModel, allowed=("public_market_capture",)) -> dict[str, DataFrame]:
    """Funnel of a verified corpus; fails when a check fails or events are missing."""
    v = verify_corpus(spark, root, allowed)
    first = v["problems"].limit(1).collect()
    if first:
        raise ValueError(f"shard {first[0]['shard']}: {first[0]['reason']}")
    books = books_of(v["events"])
    # equal times keep the recorded order; a venue's own number says nothing about other venues
    quotes = stage(books)
    usable = quotes.where("bid > 0 AND ask > 0 AND bid < ask")
    cands = stage(candidates(usable, venues, model, model.stale_ms * 1000))
    total = quotes.agg(F.count("*").alias("raw_events"))
    if total.first()[0] != v["rollup"].agg(F.sum("events")).first()[0]:
        raise ValueError("events read differ from the manifests")
    funnel = scan_funnel(cands, raw=total)
    funnel = funnel.withColumnRenamed("events", "valid_books")
    rejects = scan_rejects(quotes.withColumn("sell", F.struct(F.lit("").alias("venue")))).unionByName(
        cands.where("sell_venue IS NULL").agg(F.count("*").alias("events")).where("events > 0").select(F.lit("sin_segundo_venue").alias("cause"), "events"))
    return {"funnel": funnel, "rejects": rejects, "rollup": v["rollup"], "gates": v["gates"]}


def recorded_order(events: DataFrame) -> DataFrame:
    """Add ``seq``, a number that follows the recorded order over all shards.

    Lines of a file come in (block_start, row_id) order: a task may read splits in any order, but
    numbers rows along each. Splits are few, so their ranks come from one small ordered table.
    """
    splits = events.select("shard", "block_start").distinct()
    ranks = splits.withColumn("_rank", F.row_number().over(W.orderBy("shard", "block_start")))
    low = F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1))  # the number of a row in its task
    return events.join(small(ranks), ["shard", "block_start"]).withColumn("seq", F.col("_rank").cast("long") * (1 << 33) + low).drop("_rank")


def books_of(events: DataFrame) -> DataFrame:
    """Books of tape events: a plain projection for snapshot-only tapes, a fold when deltas occur."""
    events = recorded_order(events)
    if events.where("kind = 'delta'").isEmpty():
        return snapshot_books(events)
    return rebuild_books(events.drop("status", "source"))


def seal(reports: DataFrame, scans: DataFrame) -> DataFrame:
    """Reports and scans that agree on the corpus hash and are both public."""
    public = CLASSES["public_market_capture"]
    r = reports.where(F.col("classification") == public).select("corpus_sha256", "report_sha256", "total_events")
    s = scans.where(F.col("classification") == public).select("corpus_sha256", "scan_sha256", "cost_model_sha256", "net", "liquid_net")
    return r.join(s, "corpus_sha256").withColumn("classification", F.lit("public_market_evidence_seal"))


def verify_seal(seals: DataFrame, files: DataFrame) -> DataFrame:
    """Compare every sealed file hash with the hash of the file now: (corpus, file, ok).

    ``files``: corpus_sha256 (the corpus whose folder holds the file), file, sha256.
    """
    want = seals.select("corpus_sha256", F.inline(F.array(
        F.struct(F.lit("corpus.json").alias("file"), F.col("report_sha256").alias("expected")),
        F.struct(F.lit("corpus-scan.json").alias("file"), F.col("scan_sha256").alias("expected")))))
    now = files.select("corpus_sha256", "file", "sha256")
    return want.join(now, ["corpus_sha256", "file"], "left").select("corpus_sha256", "file", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)).alias("ok"))


def publishable(reports: DataFrame, scans: DataFrame, seals: DataFrame) -> DataFrame:
    """Whether a scan may be shown with its corpus report, and the reason when not."""
    public = CLASSES["public_market_capture"]
    c = F.col
    s = scans.select(c("report_id").alias("_id"), c("corpus_sha256").alias("_scan_sha"), c("classification").alias("_scan_class"))
    e = seals.select(c("corpus_sha256").alias("_seal_sha"), c("report_id").alias("_seal_id"))
    j = reports.join(s, c("report_id") == c("_id"), "left").join(e, c("report_id") == c("_seal_id"), "left")
    status = (
        F.when(c("classification") != public, "invalid_corpus_report")
        .when(c("_seal_sha").isNull() | (c("_seal_sha") != c("corpus_sha256")), "unsealed_evidence")
        .when(c("_id").isNull(), "missing_scan").when(c("_scan_class") != public, "non_public_scan")
        .when(c("_scan_sha") != c("corpus_sha256"), "corpus_hash_mismatch").otherwise("matched_corpus"))
    return j.select("report_id", status.alias("status")).withColumn("published", F.col("status") == "matched_corpus")
