"""Corpora, ledgers and quote files on disk, and plan shape."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tapelab.config import CostModel, venue_table
from tapelab.plans import corpus as CP
from tapelab.plans.ledger_audit import audit_documents, audit_ledger_files, document_hash_errors
from tapelab.sources.ledger import line_hash, read_jsonl_ledger, read_ledger_texts, read_ledgers
from tapelab.sources.tape import bad_lines, numbered_bad_lines, read_quotes, read_tape
from tapelab.streaming import quotes as SQ

BASE = 1_750_000_000


def iso(s):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(BASE + s, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"


def shard(root, name, start, events=40, change=None, **over):
    d = root / name
    d.mkdir()
    lines, by = [], {}
    for i in range(events):
        v = ("Binance", "OKX")[i % 2]
        by[v] = by.get(v, 0) + 1
        bid = 60000.0 + (40.0 if v == "OKX" else 0.0) + i % 5
        lines.append(json.dumps({
            "schemaVersion": 1, "localTimestamp": iso(start + i), "exchange": v, "pair": "BTC/USD", "source": {"type": "web_socket", "url": ""}, "kind": "snapshot",
            "sequenceId": i, "bids": [{"precio": bid, "cantidad": 1.0}], "asks": [{"precio": bid + 1, "cantidad": 1.0}],
            "integrity": {"status": "ok", "gap": False, "resync": False}, "observedLatencyMs": 3}))
    if change:
        lines = change(lines)
    text = "\n".join(lines) + "\n"
    (d / "events.jsonl").write_text(text)
    cfg = json.dumps({"schemaVersion": 1, "pair": "BTC/USD", "exchanges": ["Binance", "OKX"], "depth": 10})
    (d / "capture-config.json").write_text(cfg)
    m = {"schemaVersion": 1, "datasetId": name, "sourceClassification": "public_market_capture", "startedAt": iso(start), "endedAt": iso(start + events),
         "exchanges": ["Binance", "OKX"], "pairs": ["BTC/USD"], "events": len(lines), "snapshots": len(lines), "sequenceGaps": 0, "restFallbackEvents": 0, "reconnectEvents": 0,
         "deliveryPolicy": CP.LOSS_POLICY, "eventsByExchange": by, "uncompressedBytes": len(text), "durationMs": events * 1000, "sha256": hashlib.sha256(text.encode()).hexdigest(),
         "gitCommit": "a" * 40, "gitDirty": False, "configSha256": hashlib.sha256(cfg.encode()).hexdigest(), **over}
    (d / "manifest.json").write_text(json.dumps(m, indent=1))


def reasons(spark, root):
    return {(r["shard"], r.reason) for r in CP.verify_corpus(spark, str(root))["problems"].collect()}


def test_clean_corpus_scans(spark, tmp_path):
    shard(tmp_path, "s1", 0)
    shard(tmp_path, "s2", 40)  # touches s1
    shard(tmp_path, "failed-s3", 10)  # quarantined
    assert reasons(spark, tmp_path) == set()
    m = CostModel(slippage_fallback="zero", withdrawal_bps=0.0, latency_bps=0.0, stale_ms=5000)
    venues = venue_table(spark, {"Binance": (0.0, 0.0, 1.0), "OKX": (0.0, 0.0, 1.0)})
    out = CP.scan_corpus(spark, str(tmp_path), venues, m)
    f = out["funnel"].first()
    assert f.raw_events == 80 and f.valid_books == 80
    assert f.liquid_net <= f.net <= f.gross <= f.comparable == 79
    assert f.net == 79
    assert {(r.cause, r.events) for r in out["rejects"].collect()} == {("sin_segundo_venue", 1)}
    g = out["gates"].first()
    assert g.multi_venue and g.status == "insufficient_scale"


def test_overlap_tamper_and_class(spark, tmp_path):
    shard(tmp_path, "s1", 0)
    shard(tmp_path, "s2", 20, sourceClassification="synthetic_benchmark")
    shard(tmp_path, "s3", 100, events=40, sha256="0" * 64)
    shard(tmp_path, "s4", 200, change=lambda x: x[:-1], events=40, uncompressedBytes=0)
    got = reasons(spark, tmp_path)
    assert ("s2", "overlap") in got and ("s2", "classification") in got and ("s3", "sha256") in got and ("s4", "venue_counts") in got


def test_time_order_and_levels(spark, tmp_path):
    shard(tmp_path, "s1", 0, change=lambda x: x[:10] + [x[5]] + x[10:-1])
    shard(tmp_path, "s2", 100, change=lambda x: x[:-1] + [x[-1].replace('"cantidad": 1.0', '"cantidad": -1.0')])
    got = reasons(spark, tmp_path)
    assert ("s1", "time_order") in got and ("s1", "sequence_order") in got and ("s2", "bad_level") in got


def test_empty_corpus_and_bad_line(spark, tmp_path):
    (tmp_path / "x").mkdir()
    shard(tmp_path / "x", "failed-1", 0)
    with pytest.raises(ValueError):
        CP.verify_corpus(spark, str(tmp_path / "x"))
    f = tmp_path / "events.jsonl"
    f.write_text('{"schemaVersion": 1\n')
    with pytest.raises(Exception, match="events.jsonl"):
        read_tape(spark, str(f)).collect()
    assert bad_lines(spark, str(f)).count() == 1


def test_numbers_of_bad_lines(spark, tmp_path):
    """Line numbers hold in files that are read in several pieces, blank lines included."""
    good = json.dumps({"schemaVersion": 1, "localTimestamp": "2025-01-01T00:00:00Z", "exchange": "A", "filler": "x" * 40})
    want = set()
    for name, every in (("a.jsonl", 37), ("b.jsonl", 101), ("c.jsonl", 10_000)):
        rows = [good if i % every else "" if i % 2 else "{broken" if i % 4 else '{"schemaVersion": 1}' for i in range(1, 900)]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        want |= {(name, i + 1, r) for i, r in enumerate(rows) if r and r != good}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    try:
        got = numbered_bad_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file.rsplit("/", 1)[-1], r.number, r.line) for r in got} == want and len(got) == len(want)
    assert max(r.pieces for r in got) > 5


def test_file_order_survives_splits(spark, tmp_path):
    shard(tmp_path, "s1", 0, events=500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        e = read_tape(spark, f"{tmp_path}/s1/events.jsonl")
        assert e.rdd.getNumPartitions() > 2
        assert [r.sequence for r in e.orderBy("block_start", "row_id").collect()] == list(range(500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quote_files(spark, tmp_path):
    q = {"exchange": "A", "par": "BTC/USD", "bid": 1.0, "bidCantidad": 1.0, "ask": 2.0, "askCantidad": 1.0, "eventoUnixMs": 5, "recibidaEn": iso(0), "latenciaMs": 1, "secuencia": 1}
    (tmp_path / "a.jsonl").write_text(json.dumps(q) + "\n" + json.dumps(q) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([q, q, q]))
    (tmp_path / "c.json").write_text(json.dumps({"cotizaciones": [q]}, indent=2))
    (tmp_path / "d.json").write_text(json.dumps({"eventos": [q, q]}))
    rows = read_quotes(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and all(r.venue == "A" and r.bids == [] and r.event_ms == 5 for r in rows)


def ledger_doc():
    ev = [
        {"type": "fill", "fill_id": "f1", "exchange": "A", "side": "buy", "quantity_btc": "0.5", "execution_price_usd": "100", "reference_price_usd": "99", "fee_usd": "0.1"},
        {"type": "fill", "fill_id": "f2", "exchange": "B", "side": "sell", "quantity_btc": "0.5", "execution_price_usd": "110", "reference_price_usd": "111", "fee_usd": "0.2"},
        {"type": "rebalance", "from_exchange": "B", "to_exchange": "A", "btc": "0", "usd": "10", "cost_usd": "0.3"},
        {"type": "withdrawal_amortization", "exchange": "A", "cost_usd": "0.05"}]
    prev = "GENESIS"
    for i, e in enumerate(ev):
        e.update(id=f"e{i}", sequence=i + 1, previousHash=prev, hash=f"h{i}")
        prev = e["hash"]
    bal = lambda b, u: {"btc": str(b), "usd": str(u)}
    return {"version": "1", "runId": "r", "initialBalances": {"A": bal(1, 1000), "B": bal(1, 1000)}, "finalBalances": {"A": bal("1.5", "959.85"), "B": bal("0.5", "1044.5")},
            "events": ev, "markPriceUsd": "105", "reportedNetPnlUsd": "4.35", "eventCount": 4, "headHash": "h3"}


def errors(spark, tmp_path, doc, name):
    p = tmp_path / f"{name}.json"
    p.write_text(json.dumps(doc, indent=1))
    return {r.error for r in audit_documents(read_ledgers(spark, str(p)))["errors"].collect()}


def test_ledger_documents(spark, tmp_path):
    assert errors(spark, tmp_path, ledger_doc(), "ok") == set()
    d = ledger_doc()
    del d["events"][1]
    assert {"chain", "sequence", "count"} <= errors(spark, tmp_path, d, "deleted")
    d = ledger_doc()
    d["events"][0]["fee_usd"] = "0.11"
    assert errors(spark, tmp_path, d, "fee") == {"final_balances", "reported_result"}
    d = ledger_doc()
    d["events"].insert(1, d["events"][0])
    assert {"duplicate_id", "duplicate_fill"} <= errors(spark, tmp_path, d, "twice")
    d = ledger_doc()
    d["events"][1]["quantity_btc"] = "5"
    assert "negative_balance" in errors(spark, tmp_path, d, "negative")
    d = ledger_doc()
    d["reportedNetPnlUsd"] = "9"
    assert errors(spark, tmp_path, d, "pnl") == {"reported_result"}


def sealed_doc():
    """ledger_doc() with real hashes over the compact JSON of every event, amounts as written."""
    d, prev = ledger_doc(), "GENESIS"
    d["events"][0]["id"] = 'e"0\\\n\x1f/é\\u001F'
    for e in d["events"]:
        data = {k: v for k, v in e.items() if k not in ("id", "sequence", "previousHash", "hash")}
        e["previousHash"] = prev
        text = json.dumps({"id": e["id"], "sequence": e["sequence"], "previous_hash": prev, "data": data}, separators=(",", ":"), ensure_ascii=False)
        e["hash"] = prev = hashlib.sha256(text.encode()).hexdigest()
    d["headHash"] = prev
    return d


def test_ledger_own_hashes(spark, tmp_path):
    def found(doc, name):
        p = tmp_path / f"{name}.json"
        p.write_text(json.dumps(doc, indent=1))
        return {(r.id, r.error) for r in document_hash_errors(read_ledger_texts(spark, str(p))).collect()}

    assert found(sealed_doc(), "sealed") == set()
    assert audit_ledger_files(spark, str(tmp_path / "sealed.json"))["errors"].count() == 0
    d = sealed_doc()
    d["events"][1]["fee_usd"] = "0.20"  # the same amount in another text, links intact
    assert found(d, "zero") == {("e1", "hash"), ("e2", "chain")}
    d = sealed_doc()
    d["events"][3]["cost_usd"] = "0.050"
    assert found(d, "tail") == {("e3", "hash"), ("", "head")}
    d = sealed_doc()
    for e in d["events"][:2]:
        e["hash"] = "0" * 64
    assert {("e1", "hash"), ("e1", "chain"), ("e2", "chain")} <= found(d, "two")
    assert {r.error for r in audit_ledger_files(spark, str(tmp_path / "two.json"))["errors"].collect()} == {"hash", "chain"}
    d = sealed_doc()
    d["events"][2]["type"] = "other"
    assert ("e2", "hash") in found(d, "kind")
    d = sealed_doc()
    del d["events"][3]["cost_usd"]
    assert ("e3", "hash") in found(d, "missing")
    d = sealed_doc()
    d.update(events=[], eventCount=0, headHash="GENESIS")
    assert found(d, "empty") == set()


def test_jsonl_ledger_hash(spark, tmp_path):
    prev, lines = "GENESIS", []
    for i in range(1, 4):
        payload = {"z": i, "a": [1.50, "x"]}
        text = json.dumps([i, iso(i), "op", payload, prev], separators=(",", ":"))
        h = hashlib.sha256(text.encode()).hexdigest()
        lines.append(json.dumps({"sequence": i, "timestamp": iso(i), "event": "op", "payload": payload, "previousHash": prev, "hash": h}, separators=(",", ":")))
        prev = h
    lines[2] = lines[2].replace('"z":3', '"z":4')
    (tmp_path / "l.jsonl").write_text("\n".join(lines) + "\n")
    df = read_jsonl_ledger(spark, str(tmp_path / "l.jsonl"))
    assert {r.sequence: r.ok for r in df.select("sequence", (line_hash() == F.col("hash")).alias("ok")).collect()} == {1: True, 2: True, 3: False}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_product_of_rows_and_pruned_scans(spark):
    import __spark_entry__ as entry

    for name in ("corpus_scan_funnel", "drawdown_by_route", "rolling_zscore", "hash_chain_audit", "route_join"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text
        assert "ReadSchema" in text
    text = plan(entry.queries()["ledger_totals"](spark, SF))
    assert "o_orderstatus" in text and "c_name" not in text


def test_silence_alert_processor(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = tmp_path / "in"
        spark.createDataFrame([("A", "P", 1), ("A", "P", 5), ("B", "P", 2)], "venue string, pair string, t bigint").write.parquet(str(src))
        s = spark.readStream.schema("venue string, pair string, t bigint").parquet(str(src))
        q = SQ.silence_alerts(s, 1).writeStream.outputMode("update").format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        import time

        for _ in range(40):
            time.sleep(1)
            rows = {(r.venue, r.last_t) for r in spark.table("silent").collect()}
            if len(rows) == 2:
                break
        q.stop()
        assert rows == {("A", 5), ("B", 2)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
