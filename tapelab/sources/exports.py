"""Exports: unified CSV log, JSON state with a fingerprint, evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the unified log and kinds in collection order.
COLUMNS = ("tipo", "tiempo", "ruta", "detalle", "cantidad_btc", "utilidad_usd", "diferencial_neto_bps", "score", "costo_usd", "decision_code", "decision_reason")
KINDS = ("parametro", "operacion", "evento", "transicion", "ejecucion", "auditoria", "rebalanceo")
PLACES = {"cantidad_btc": 8, "utilidad_usd": 4, "diferencial_neto_bps": 4, "score": 6, "costo_usd": 4}
REPORT = (
    "strategy", "pnl_net_usd", "pnl_per_btc_usd", "pnl_per_deployed_capital", "max_drawdown_usd", "fill_rate_quantity", "fill_rate_orders",
    "profit_factor", "max_exposure_usd", "unwind_rate", "turnover_usd", "total_costs_usd", "stability_between_windows", "negative_windows", "rejections_by_cause")


def fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


def unified_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Typed logs as one: {kind: table with some of COLUMNS[1:]}; missing cells are empty.

    ``kind_rank`` keeps the kinds in collection order.
    """
    out = None
    for rank, kind in enumerate(KINDS):
        if kind not in tables:
            continue
        df = tables[kind]
        cells = [F.lit(kind).alias("tipo")]
        for c in COLUMNS[1:]:
            if c not in df.columns:
                v = F.lit("")
            elif c in PLACES:
                v = F.coalesce(fixed(F.col(c).cast("double"), PLACES[c]), F.lit(""))
            else:
                v = F.coalesce(F.col(c).cast("string"), F.lit(""))
            cells.append(v.alias(c))
        part = df.select(*cells, F.lit(rank).alias("kind_rank"))
        out = part if out is None else out.unionByName(part)
    return out


def write_unified_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV files with a header, globally ordered by kind and time (range partitioning)."""
    rows.orderBy("kind_rank", "tiempo").select(*COLUMNS).write.option("quoteAll", True).option("header", True).csv(path)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free 64-bit sum of row hashes: equal tables, equal fingerprints.

    The halves of the hash are summed apart so that no sum can overflow for any real table.
    """
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    lo, hi = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return df.agg(F.count("*").alias("rows"), F.sum(lo).alias("low"), F.sum(hi).alias("high"))


def export_json(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table as JSON lines and return their fingerprints."""
    out = None
    for name, df in tables.items():
        df.write.json(f"{path}/{name}")
        f = table_fingerprint(df).select(F.lit(name).alias("table"), "rows", "low", "high")
        out = f if out is None else out.unionByName(f)
    return out


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON text with keys in alphabetical order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def _finite(x: str) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit("inf")).otherwise(fixed(F.col(x), 8))


def report_rows(metrics: DataFrame) -> DataFrame:
    """Backtest metrics as the fifteen text columns of the report; infinite values read 'inf'."""
    src = {
        "pnl_net_usd": "pnl_usd", "pnl_per_btc_usd": "pnl_per_btc_usd", "pnl_per_deployed_capital": "pnl_per_capital", "max_drawdown_usd": "max_drawdown_usd",
        "fill_rate_quantity": "fill_rate_quantity", "fill_rate_orders": "fill_rate_orders", "profit_factor": "profit_factor", "max_exposure_usd": "max_exposure_usd",
        "unwind_rate": "unwind_rate", "turnover_usd": "turnover", "total_costs_usd": "costs", "stability_between_windows": "stability"}
    return metrics.select(
        "strategy", *[_finite(src[c]).alias(c) for c in REPORT[1:13]], F.col("negative_windows").cast("string").alias("negative_windows"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values("rejections", lambda k, v: v.cast("bigint")))))).alias("rejections_by_cause"))


def write_report(metrics: DataFrame, path: str) -> None:
    report_rows(metrics).write.option("header", True).csv(f"{path}/csv")
    metrics.write.json(f"{path}/json")
