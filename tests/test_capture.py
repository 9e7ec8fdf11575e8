"""Recorded shards: manifests that verify, quarantine, numbering, and a batch that is killed and repeated."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tapelab.plans import corpus as CP
from tapelab.streaming import capture as C
from tapelab.streaming import quotes as SQ
from test_corpus import iso


def tape(root, name, start, n=40, bad=()):
    lines = []
    for i in range(n):
        qty = -1.0 if start + i in bad else 1.0
        lines.append(json.dumps({
            "schemaVersion": 1, "localTimestamp": iso(start + i), "exchangeTimestamp": iso(start + i - 1), "exchange": ("Binance", "OKX")[i % 2], "pair": "BTC/USD", "source": {"type": "rest" if i % 4 == 0 else "web_socket", "url": ""},
            "kind": "snapshot", "sequenceId": start + i, "bids": [{"precio": 100.0 + i, "cantidad": qty}], "asks": [{"precio": 101.0 + i, "cantidad": 1.0}],
            "integrity": {"status": "ok", "gap": i == 3, "resync": False, "connectionEpoch": 1, "reconnected": i == 5}, "observedLatencyMs": 3}))
    (root / name).write_text("\n".join(lines) + "\n")


def record(spark, tmp_path, **more):
    C.capture(SQ.replay(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), minutes=1, **{"commit": "a" * 40, "dirty": False, **more})


def folders(tmp_path):
    return sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(("_", ".")))


def numbers(tmp_path):
    return [int(n.removeprefix("failed-").split("-")[1]) for n in sorted(folders(tmp_path), key=lambda n: n.removeprefix("failed-"))]


def test_recorded_corpus_verifies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    tape(tmp_path / "in", "a.jsonl", 0, 130)
    record(spark, tmp_path, rows=25)
    got = CP.verify_corpus(spark, str(tmp_path / "out"))
    assert got["problems"].collect() == []
    assert got["shards"].agg(F.sum("events"), F.sum("rest"), F.sum("gaps"), F.sum("reconnects")).first()[:] == (130, 33, 1, 1)
    assert got["shards"].agg(F.max("events")).first()[0] <= 25
    assert numbers(tmp_path) == list(range(len(folders(tmp_path))))
    tape(tmp_path / "in", "b.jsonl", 200, 30)  # a later run numbers on
    before = len(folders(tmp_path))
    record(spark, tmp_path, rows=25)
    assert numbers(tmp_path) == list(range(len(folders(tmp_path)))) and len(folders(tmp_path)) > before


def test_failed_shards_go_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    tape(tmp_path / "in", "a.jsonl", 0, 120, bad={50})
    record(spark, tmp_path)
    failed = [n for n in folders(tmp_path) if n.startswith("failed-")]
    assert len(failed) == 1
    reasons = json.loads((tmp_path / "out" / failed[0] / "failed.json").read_text())["reasons"]
    assert reasons == ["bad_level"]
    assert CP.verify_corpus(spark, str(tmp_path / "out"))["problems"].count() == 0
    events = CP.verify_corpus(spark, str(tmp_path / "out"))["events"].count()
    lost = len((tmp_path / "out" / failed[0] / "events.jsonl").read_text().splitlines())
    assert events + lost == 120 and events > 0
    tape(tmp_path / "in", "b.jsonl", 600, 300, bad={600, 660, 720, 780, 840, 650, 700, 760, 820, 880})
    with pytest.raises(StreamingQueryException, match="in a row"):
        record(spark, tmp_path)


def test_killed_batch_is_repeated(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    tape(tmp_path / "in", "a.jsonl", 0, 200)
    calls, keep = [], C.Folder.write

    def killed(self, name, text):
        if name.endswith("manifest.json"):
            calls.append(name)
            if len(calls) == 2:
                raise OSError("killed")
        keep(self, name, text)

    monkeypatch.setattr(C.Folder, "write", killed)
    with pytest.raises(StreamingQueryException):
        record(spark, tmp_path)
    first = folders(tmp_path)
    assert sum((tmp_path / "out" / n / "manifest.json").exists() for n in first) == 1 and len(first) == 2
    monkeypatch.setattr(C.Folder, "write", keep)
    record(spark, tmp_path)
    assert sum(n.startswith("failed-") for n in folders(tmp_path)) == 1  # the one that was cut off
    assert [n for n in folders(tmp_path) if not n.startswith("failed-")][0] == first[0]
    got = CP.verify_corpus(spark, str(tmp_path / "out"))
    assert got["problems"].collect() == [] and got["events"].count() == 200
    assert not (tmp_path / "out" / "_work" / "batch=0").exists()
