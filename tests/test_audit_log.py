"""Appends to a log on disk: one row per (kind, id), however far apart in time."""

import datetime as dt

from pyspark.sql import functions as F

from tapelab.sources import audit_log as AL

DAY = dt.datetime(2025, 1, 1)


def rows(spark, *ids, days=0):
    df = spark.createDataFrame([(i, DAY + dt.timedelta(days=days)) for i in ids], "n long, at timestamp")
    return AL.log_rows(df, "evento", F.col("n"), F.col("at"))


def logged(spark, path):
    return sorted((r["id"], (r["time"] - DAY).days) for r in AL.read_log(spark, path).collect())


def test_ids_far_apart_in_time(spark, tmp_path):
    path = str(tmp_path / "log")
    AL.append(rows(spark, 7), path)
    AL.append(rows(spark, 7, 8, days=200), path)
    AL.append(rows(spark, 8, days=-200), path)
    assert logged(spark, path) == [("7", 0), ("8", 200)]
    assert AL.read_keys(spark, path).count() == 2


def test_rows_without_keys_are_found(spark, tmp_path):
    path = str(tmp_path / "log")
    rows(spark, 7).withColumn("date", F.to_date("time")).write.partitionBy("kind", "date").parquet(path)  # a log without keys
    AL.append(rows(spark, 7, 8, days=300), path)
    rows(spark, 9).withColumn("date", F.to_date("time")).write.mode("append").partitionBy("kind", "date").parquet(path)
    (tmp_path / "log" / "_open").touch()  # a writer that ended before it wrote its keys
    AL.append(rows(spark, 7, 8, 9, days=400), path)
    assert logged(spark, path) == [("7", 0), ("8", 300), ("9", 0)]
    assert not (tmp_path / "log" / "_open").exists()


def test_purge_keeps_what_the_log_still_has(spark, tmp_path):
    path = str(tmp_path / "log")
    AL.append(rows(spark, 7, 8), path)
    AL._write_keys(spark.createDataFrame([("evento", "5", DAY)], "kind string, id string, claimed_at timestamp"), path)  # its row is gone
    AL.purge(spark, path, F.lit(DAY + dt.timedelta(days=100)))
    assert sorted(r["id"] for r in AL.read_keys(spark, path).collect()) == ["5", "7", "8"]
    AL.purge(spark, path, F.lit(DAY + dt.timedelta(days=300)))
    assert sorted(r["id"] for r in AL.read_keys(spark, path).collect()) == ["7", "8"]


def test_a_cut_off_purge_loses_no_key(spark, tmp_path):
    import shutil

    path = str(tmp_path / "cut")
    AL.append(rows(spark, *range(50)), path)
    shutil.copytree(f"{path}/_keys", f"{path}/_keys-kept")  # written, but the old keys still stand
    AL.append(rows(spark, 3, 90, days=30), path)
    assert AL.read_log(spark, path).count() == 51 and not (tmp_path / "cut" / "_keys-kept").exists()
    shutil.move(f"{path}/_keys", f"{path}/_keys-kept")  # the old keys are gone already
    AL.append(rows(spark, 4, 91, days=30), path)
    assert AL.read_log(spark, path).count() == 52 and AL.read_keys(spark, path).count() == 52
    AL.purge(spark, path, F.lit("2027-01-01").cast("timestamp"))
    assert AL.read_keys(spark, path).count() == 52  # all rows are still in the log


def test_few_ids_read_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "few")
    AL.append(rows(spark, *range(3000)), path)
    AL.append(rows(spark, 7, 5000, days=240), path)
    assert AL.read_log(spark, path).count() == 3001
    plan = AL.read_keys(spark, path).where(F.col("id").isin(["7"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [7])]" in plan or "EqualTo(id,7)" in plan or "id" in plan.split("PushedFilters")[1]
