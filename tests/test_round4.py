"""Files written by tasks, rows shuffled once, tapes parsed once."""

import hashlib
import json
import os
import random

import pytest

from pyspark.sql import functions as F

from tapelab.catalog import audit, streams
from tapelab.operators.ordered import rolling_sums
from tapelab.operators.routes import rank_candidates
from tapelab.sources import files as FI
from tapelab.sources import tape as TP
from tapelab.streaming import capture as C
from test_capture import record, tape


def shuffles(df, column):
    """How many exchanges of the plan carry ``column``."""
    plan = df._jdf.queryExecution().executedPlan()
    found, nodes = 0, [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while nodes:
        node = nodes.pop()
        found += node.nodeName() == "Exchange" and f"{column}#" in node.output().mkString(",")
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_sealed_files_are_written_and_hashed_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(k,) for k in (1, 2, 4, 4, 5, 8, 19)]  # a corpus that comes twice has two lines in a file, as before
    spark.createDataFrame(rows, "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(audit, "folder", lambda spark, name: str(tmp_path / name))
    out = audit.seal_verification(spark, str(tmp_path))
    sha = lambda k: hashlib.sha256(f"{'y' if k % 19 == 0 else 'c'}{k}".encode()).hexdigest()
    want = {}
    for k in {k for k, in rows}:
        n = rows.count((k,))
        want[sha(k), "corpus.json"] = (n, k % 5 != 0 and n == 1)
        want[sha(k), "corpus-scan.json"] = (n, k % 4 != 0 and n == 1)
    assert {(r.corpus_sha256, r.file): (r.n, r.ok) for r in out.collect()} == want
    made = [n for _, _, names in os.walk(tmp_path / "sealed") for n in names]
    assert sorted(made) == ["corpus-scan.json"] * 5 + ["corpus.json"] * 6  # nothing beside the documents


def test_hashes_below_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x.txt", "one"), ("a", "x.txt", "one"), ("b", "y z.txt", None), ("b", "x.txt", "é")], "folder string, file string, text string")
    FI.write_texts(rows, str(tmp_path))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden").write_text("")
    got = {tuple(r["path"].rsplit("/", 2)[1:]): (r["bytes"], r["sha256"]) for r in FI.hashes_below(spark, f"file:{tmp_path}").collect()}
    texts = {("a", "x.txt"): b"one\none\n", ("b", "y z.txt"): b"\n", ("b", "x.txt"): "é\n".encode()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in texts.items()}
    os.mkdir(tmp_path / "none")
    assert FI.hashes_below(spark, str(tmp_path / "none")).collect() == [] and FI.hashes_below(spark, f"{tmp_path}/*") is None
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", F.sha2("content", 256)).collect()
    assert {tuple(r) for r in by_spark} == {(r["path"], r["sha256"]) for r in FI.hashes_below(spark, str(tmp_path)).collect()}


def test_rolling_sums_shuffle_rows_once(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([None, i // 40]), i, rnd.choice([None, *range(-40, 60)])) for i in range(900)]
    rows += [(4, 5, i, i) for i in range(900, 950)] + [(5, 1, 2000, 3)]
    df = spark.createDataFrame(rows, "run int, t bigint, seq bigint, pnl bigint")
    for back, chunk, parts in ((50, 60, 7), (7, 7, 5), (3, 40, 1), (20, 10_000, 4)):
        out = rolling_sums(df, ["run"], ["t", "seq"], {"s": F.col("pnl") * 2}, back, chunk=chunk, parts=parts)
        assert shuffles(out, "pnl") == 1
        seen, want = {}, {}
        for run, t, seq, pnl in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            before = seen.setdefault(run, [])
            want[seq] = (len(before), sum(2 * (v or 0) for v in before[-back:]))
            before.append(pnl)
        got = out.collect()
        assert {r.seq: (r["rank"], r.s) for r in got} == want and len(got) == len(rows)
        assert all(r.n == len(seen[r.run]) for r in got)


def test_candidates_are_computed_once_and_shuffled_once(spark):
    df = spark.range(300).select((F.col("id") % 4).alias("tick"), F.col("id").alias("seq"), (F.col("id") * 7 % 11).cast("double").alias("score"), (F.col("id") % 3 > 0).alias("executable"))
    out = rank_candidates(df.repartition(5, "score"), ["tick"], "score", ["seq"])
    assert shuffles(out, "seq") == 1 and out.count() == 200


@pytest.mark.parametrize(("starts", "in_order"), [((0, 60, 120, 180), True), ((60, 120, 0, 180), False), ((0, 60, 98, 180), False)])
def test_order_of_a_corpus_from_lines_parsed_once(spark, tmp_path, monkeypatch, starts, in_order):
    for i, start in enumerate(starts):
        shard = tmp_path / f"shard-{i:06d}-x"
        shard.mkdir()
        (shard / "manifest.json").write_text(json.dumps({"schemaVersion": 1}))
        tape(shard, "events.jsonl", start)
    monkeypatch.setattr(streams, "captured", lambda spark, sf: str(tmp_path))
    out = streams.corpus_events(spark, "")
    assert "scan json" not in out._jdf.queryExecution().executedPlan().toString().lower()
    rows = out.collect()
    assert {r.in_order for r in rows} == {in_order} and sum(r.events for r in rows) == 40 * len(starts)


def test_files_of_windows_need_no_ranks(spark):
    events = spark.range(100).select((F.col("id") * 7_000_000 % 300_000_000).alias("t"), F.col("id").alias("sequence"))
    whole, several = (C.cut(events, 1, n, ["t", "sequence"]) for n in (30, 6))
    assert shuffles(whole, "t") == 0 and whole.columns == several.columns == ["t", "sequence", "cut"]
    seen, want = {}, {}
    for r in sorted(events.collect()):
        window = r.t - r.t % 60_000_000
        want[r.sequence] = (f"{window}-0", f"{window}-{seen.setdefault(window, 0) // 6}")
        seen[window] += 1
    assert 6 < max(seen.values()) <= 30
    a, b = ({r.sequence: r.cut for r in x.collect()} for x in (whole, several))
    assert {k: (a[k], b[k]) for k in a} == want


def test_shards_hold_their_documents_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    tape(tmp_path / "in", "a.jsonl", 0, 130)
    record(spark, tmp_path)
    shards = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("shard-")]
    assert shards and all(sorted(os.listdir(p)) == ["capture-config.json", "events.jsonl", "manifest.json"] for p in shards)
    assert {r.shard for r in TP.read_tape(spark, f"{tmp_path}/out/*/events.jsonl").collect()} == {p.name for p in shards}
