"""Time windows, retention and 'latest' views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000


def _newest(df: DataFrame, t: str):
    """The largest ``t``: fetched first, so that what follows is a comparison with a constant, which a scan can push down."""
    return df.agg(F.max(t)).first()[0]


def last_minutes(df: DataFrame, t: str, minutes: int, unit_us: int = MINUTE_US) -> DataFrame:
    """Rows of the last 1..60 minutes before the newest row."""
    if not 1 <= minutes <= 60:
        raise ValueError("minutes must be in 1..60")
    top = _newest(df, t)
    return df.where("false") if top is None else df.where(F.col(t) >= F.lit(top - minutes * unit_us))


def keep_days(df: DataFrame, t: str, days: int, date: str | None = None) -> DataFrame:
    """Rows of the newest ``days`` calendar days; ``date`` names a date column by which the table is partitioned."""
    top = _newest(df, t)
    if top is None:
        return df.where("false")
    first = (top // DAY_US - days + 1) * DAY_US
    kept = df.where(F.col(t) >= F.lit(first))
    return kept if date is None else kept.where(F.col(date) >= F.to_date(F.lit(str(dt.date(1970, 1, 1) + dt.timedelta(microseconds=first)))))


def latest_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows of the whole table. Spark keeps n rows per task before merging."""
    top = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    # the window sees n rows only
    w = W.orderBy(*[F.col(c).desc() for c in order])
    return top.withColumn("newest", F.row_number().over(w).cast("bigint"))


def latest_batch(df: DataFrame, t: str) -> DataFrame:
    """Rows that carry the newest detection time."""
    top = _newest(df, t)
    return df.where("false") if top is None else df.where(F.col(t) == F.lit(top))
