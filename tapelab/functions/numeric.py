"""Small numeric helpers shared by all expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_SCAN = 1.96
Z_CALIBRATION = 1.959963984540054


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(x)))


def is_finite(x) -> Column:
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def bps(value, base) -> Column:
    """value / base in basis points; 0 when the base is not positive."""
    return F.when(col(base) > 0, col(value) / col(base) * 10000.0).otherwise(0.0)


def ratio(num, den, floor: float = 1.0) -> Column:
    """num / max(den, floor): a share that is 0, not NULL, for an empty group."""
    return col(num).cast("double") / F.greatest(col(den).cast("double"), F.lit(float(floor)))


def per_million(count, total) -> Column:
    return ratio(count, total) * 1000000.0


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(x, -30.0, 30.0)))


def logit(p) -> Column:
    p = clamp(p, 1e-6, 1.0 - 1e-6)
    return F.ln(p / (1.0 - p))


def wilson(count, total, z: float = Z_SCAN) -> Column:
    """Wilson score interval as struct(rate, lower, upper); [0, 1] for an empty sample."""
    n = col(total).cast("double")
    k = F.least(col(count).cast("double"), n)
    p = k / n
    denom = 1.0 + z * z / n
    center = (p + z * z / (2.0 * n)) / denom
    margin = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / denom
    empty = col(total) == 0
    return F.struct(
        F.when(empty, 0.0).otherwise(p).alias("rate"),
        F.when(empty, 0.0).otherwise(clamp(center - margin, 0.0, 1.0)).alias("lower"),
        F.when(empty, 1.0).otherwise(clamp(center + margin, 0.0, 1.0)).alias("upper"),
    )


def dp(x, places: int) -> Column:
    """Round to ``places`` decimals (12 for costs, 8 for quantities, 6 for stored text)."""
    return F.round(col(x), places)


def duration_ms(text) -> Column:
    """Milliseconds of a duration such as '10s', '30m' or '6h'; other units give NULL."""
    text = F.trim(col(text))
    n = F.regexp_extract(text, r"^(\d+)[hms]$", 1)
    unit = F.element_at(
        F.create_map(F.lit("h"), F.lit(3600000), F.lit("m"), F.lit(60000), F.lit("s"), F.lit(1000)),
        F.substring(text, -1, 1),
    )
    return F.when(n != "", n.cast("bigint") * unit)


def micros(ts) -> Column:
    """Microseconds since the epoch, also for TIMESTAMP_NTZ columns (session zone UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))
