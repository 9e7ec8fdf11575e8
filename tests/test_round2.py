"""Cases that were once wrong: self-transfers, seals of several corpora, cut-offs that must prune, trailing JSON."""

import json

import pytest
from pyspark.sql import functions as F

from tapelab.operators.calibration import fit_isotonic
from tapelab.operators.retention import keep_days, last_minutes
from tapelab.plans.corpus import verify_seal
from tapelab.plans.ledger_audit import negative_balances, running_balances
from tapelab.sources.tape import read_documents


def test_self_transfer_is_one_change(spark):
    changes = spark.createDataFrame([("l", 1, "e", "A", 0, -100), ("l", 1, "e", "A", 0, 100)], "ledger string, sequence bigint, id string, at string, btc bigint, usd bigint")
    start = spark.createDataFrame([("l", "A", 1, 50)], "ledger string, at string, btc bigint, usd bigint")
    after = running_balances(changes, start)
    assert [(r.btc_after, r.usd_after) for r in after.collect()] == [(1, 50)]
    assert negative_balances(after).isEmpty()


def test_seals_of_two_corpora(spark):
    seals = spark.createDataFrame([("c1", "r1", "s1"), ("c2", "r2", "s2")], "corpus_sha256 string, report_sha256 string, scan_sha256 string")
    files = spark.createDataFrame([("c1", "corpus.json", "r1"), ("c2", "corpus.json", "r1"), ("c1", "corpus-scan.json", "s1"), ("c2", "corpus-scan.json", "s2")],
                                  "corpus_sha256 string, file string, sha256 string")
    got = {(r.corpus_sha256, r.file): r.ok for r in verify_seal(seals, files).collect()}
    assert got == {("c1", "corpus.json"): True, ("c2", "corpus.json"): False, ("c1", "corpus-scan.json"): True, ("c2", "corpus-scan.json"): True}


def test_cut_offs_reach_the_scan(spark, tmp_path):
    day = 86_400_000_000
    rows = spark.range(1000).select(F.expr(f"id * {day} div 10").alias("t")).withColumn("date", F.to_date(F.timestamp_micros("t")))
    rows.write.partitionBy("date").parquet(str(tmp_path / "r"))
    table = spark.read.parquet(str(tmp_path / "r"))
    recent = keep_days(table, "t", 3, date="date")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t," in plan and "PartitionFilters: [isnotnull(date" in plan
    assert recent.count() == 30
    assert last_minutes(table, "t", 60).count() == 1 and last_minutes(table.where("false"), "t", 5).count() == 0


def test_trailing_content_is_an_error(spark, tmp_path):
    q = json.dumps({"exchange": "A", "par": "X", "bid": 1.0})
    for i, text in enumerate((f"[{q}][{q}]", f"{q}{q}", f"[{q}] x", "no json")):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "a.json").write_text(text)
        with pytest.raises(Exception):
            read_documents(spark, str(folder)).collect()
    (tmp_path / "good.json").write_text(f"\n [{q},\n {q}]\n")
    assert read_documents(spark, str(tmp_path / "good.json")).where("exchange = 'A'").count() + read_documents(
        spark, str(tmp_path / "good.json")).where("cotizaciones IS NOT NULL").count() >= 1


def test_isotonic_fit_is_not_rounded(spark):
    rows = [(0.1 + i * 1e-7, int(i >= 50)) for i in range(100)]
    steps = fit_isotonic(spark.createDataFrame(rows, "p double, y int"), "p", "y")
    assert [v for _, v in steps] == [0.0, 1.0]


def test_staged_tables_are_deleted(spark):
    from tapelab.session import stage, staging

    with staging(spark):
        df = stage(spark.range(3))
        path = df.inputFiles()[0]
        assert df.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_normalised_messages_keep_all_levels(spark):
    from tapelab.sources.normalise import DEPTH, normalise

    levels = [[str(100 - i), "1"] for i in range(25)]
    payload = json.dumps({"lastUpdateId": 7, "bids": levels, "asks": [["101", "2"]]})
    raw = spark.createDataFrame([("Binance", 1, payload)], "venue string, local_t bigint, payload string")
    assert len(normalise(raw).first().bids) == 25 and len(normalise(raw, depth=DEPTH).first().bids) == 10
