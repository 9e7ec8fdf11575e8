"""Replay of recorded ticks on a strictly rising clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.operators.ordered import ranked, running
from tapelab.operators.routes import cooldown


def replay_clock(df: DataFrame, ms: str, order: list[str], step_ms: int = 250, parts: int | None = None) -> DataFrame:
    """Add ``clock`` (recorded time, ties and steps back moved on by 1 ms) and ``cycle``.

    clock_i = max(clock_(i-1) + 1, t_i) has the closed form i + max over j <= i of (t_j - j).
    ``cycle`` is the cell of ``step_ms`` on a fixed grid; for the ticks at which a sequential replay
    analyses see :func:`analyses`.
    """
    rows = ranked(df, [], order, parts).withColumn("_lead", F.col(ms) - F.col("rank"))
    rows = running(rows, [], ["rank"], {"_top": ("max", "_lead")}, parts)
    rows = rows.withColumn("clock", F.col("_top") + F.col("rank"))
    return rows.withColumn("cycle", F.floor(F.col("clock") / step_ms)).drop("_lead", "_top")


def analyses(ticks: DataFrame, step_ms: int = 250, parts: int | None = None) -> DataFrame:
    """Clocks of the ticks that are analysed: the first, each that is ``step_ms`` or more after the last analysed one, and the last.

    The grid starts anew at every analysis, so this is a chain through all ticks; it is followed in
    buckets as a cooldown is. ``ticks`` has the ``clock`` of :func:`replay_clock`.
    """
    taken = cooldown(ticks.select("clock"), [], "clock", step_ms, parts)
    last = ticks.agg(F.max("clock").alias("clock")).where("clock IS NOT NULL")
    return taken.unionByName(last).distinct()
