"""Steps that must not grow faster than their input."""

import datetime
import glob
import hashlib
import os
import random

from pyspark.sql import functions as F

from tapelab.catalog import audit, streams, trades
from tapelab.functions import edge as E
from tapelab.operators.ordered import rolling_time
from tapelab.sources import ledger as LG
from tapelab.sources import tape as TP
from tapelab.streaming import history as H
from tapelab.streaming import quotes as Q


def test_hashes_of_the_files_below_a_folder(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    (tmp_path / "a" / "b" / "x.txt").write_text("one")
    (tmp_path / "y.txt").write_text("two")
    assert {r.sha256 for r in TP.file_hashes(spark, str(tmp_path)).collect()} == {hashlib.sha256(t).hexdigest() for t in (b"one", b"two")}


def test_sum_of_clocks_beyond_a_long(spark, tmp_path):
    n, day = 40_000, datetime.date(9999, 12, 31)
    c = F.col("id")
    money = lambda x: F.lit(x).cast("double")
    spark.range(n).select(
        c.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).cast("bigint").alias("l_partkey"), F.lit(2).cast("bigint").alias("l_suppkey"), money(10).alias("l_extendedprice"),
        money(1).alias("l_quantity"), money(0.05).alias("l_discount"), money(0.01).alias("l_tax"), F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.lit(day).alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    row = trades.replay_clock(spark, str(tmp_path)).first()
    ms = (day - datetime.date(1970, 1, 1)).days * 86_400_000
    assert int(row.clock_sum) == n * ms + n * (n - 1) // 2 > 2**63


def test_rolling_time_against_plain_python(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(300), rnd.randrange(-50, 50)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    out = rolling_time(df, ["k"], "t", 20, {"p": F.sum("v")}, {"lo": ("min", "p"), "hi": ("max", "p"), "s": ("sum", "p")})
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rangeframe" not in plan.replace(" ", "")  # a frame that slides is folded anew for every row
    at = {}
    for k, t, v in rows:
        at[k, t] = at.get((k, t), 0) + v
    got = {(r.k, r.t): (r.lo, r.hi, r.s) for r in out.collect()}
    want = {}
    for k, t in at:
        inside = [p for (j, u), p in at.items() if j == k and t - 20 <= u <= t]
        want[k, t] = (min(inside), max(inside), sum(inside))
    assert got == want


def test_slices_are_files_whose_times_rise(spark, tmp_path):
    rows = spark.range(1000).select((F.lit(999) - F.col("id")).alias("seq"))
    path = str(tmp_path / "in")
    streams.write_slices(rows, path, lambda placed, to: placed.write.partitionBy("file").parquet(to))
    files = sorted(glob.glob(f"{path}/*.parquet"), key=os.path.getmtime)
    ends = [spark.read.parquet(f).agg(F.min("seq"), F.max("seq"), F.count("*")).first() for f in files]
    assert len(files) == streams.SLICES and len({os.path.getmtime(f) for f in files}) == len(files)
    assert sum(e[2] for e in ends) == 1000 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_state_holds_an_element_per_piece_of_input(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    minute = 60_000_000
    rows = [("A", "P", 1440 * minute + i, i, 1.0, 2.0) for i in range(500)]
    spark.createDataFrame(rows, "venue string, pair string, t bigint, seq bigint, bid double, ask double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("venue string, pair string, t bigint, seq bigint, bid double, ask double").parquet(src)
    stream = stream.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", "0 seconds")
    with H.with_state_store(spark):
        H.to_table(H.rolling_state(stream, minutes=10), out, cp)
    held = spark.read.format("statestore").option("path", cp).option("stateVarName", "rows").load()
    assert held.count() == 1
    assert sorted((r.t, r.seq, r.bid, r.ask) for r in H.retained(spark, cp).collect()) == [r[2:] for r in rows]


def test_newest_folder_is_found_by_name(spark, tmp_path):
    path = str(tmp_path / "history")
    day = 86_400_000_000
    rows = spark.createDataFrame([(1, 0), (5 * day, 0), (6 * day, 1)], "t bigint, batch int")
    rows.withColumn("folder", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd")).write.partitionBy("folder", "batch").parquet(path)
    os.mkdir(f"{path}/folder=1970-01-03")  # a folder without files has no part in the listing of rows
    assert Q._folders(spark, path) == ["1970-01-01", "1970-01-03", "1970-01-06", "1970-01-07"]
    assert Q.expire(spark, path, 60, "yyyy-MM-dd") == ["folder=1970-01-01", "folder=1970-01-03"]


def test_hashes_of_a_chain_of_texts(spark):
    texts = [f'{{"id":"e\\"{i}","previous_hash":"","n":{i}}}' for i in range(3)]
    got = spark.createDataFrame([(texts,)], "x array<string>").select(LG.chained_hashes("g")("x")).first()[0]
    head, want = "g", []
    for t in texts:
        head = hashlib.sha256(t.replace('"previous_hash":""', f'"previous_hash":"{head}"').encode()).hexdigest()
        want.append(head)
    assert got == want


def test_documents_of_quotes_share_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "folder", lambda spark, name: str(tmp_path / name))
    assert sum(r["quotes"] for r in audit.quote_scan(spark, "/root/testdata/sf0.001").collect()) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert not [n for n in os.listdir(tmp_path / "quotes/docs") if os.path.isdir(tmp_path / "quotes/docs" / n)]


def test_best_of_nested_points(spark):
    rows = spark.createDataFrame([(1, 2.0, 10.0, 11.0), (1, 2.0, 10.0, 11.0), (2, 3.0, 10.0, 9.0), (3, None, 10.0, 12.0)], "id int, qty double, buy_price double, sell_price double")
    rows = rows.withColumn("costs", F.expr("named_struct('fee_buy', 0.1D, 'fee_sell', 0.1D, 'slippage', 0.2D, 'withdrawal', 0.1D, 'latency', 0.0D, 'adverse', 0.1D, 'total', 0.8D)"))
    nested, plain = (E.best_capacity(E.capacity(rows, ["id"], nested=x), ["id"]).orderBy("id").collect() for x in (True, False))
    assert nested == plain and len(nested) == 3
