"""Registered queries against their SQL twins; TAPELAB_ALL=1 runs every one of them."""

import os

import oracle
import pytest
from conftest import SF

import __spark_entry__ as entry

CORE = """corpus_scan_funnel best_pair_unbounded opportunities book_rebuild sequence_exact rolling_zscore
drawdown_by_route rank_percentile latency_ewma retention_rows strategy_backtest event_markouts impact_model_comparison
kpss_test genome_fitness manifest_reconciliation shard_overlaps index_first_page audit_append hash_chain_audit
execution_invariants tape_scan payload_normalisation stream_latest_quotes stream_audit_sink holm_adjustment""".split()
NAMES = list(entry.queries()) if os.environ.get("TAPELAB_ALL") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    rows, verdict = oracle.compare(spark, oracle.connect(SF), entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert verdict in ("ok", "rows only"), verdict
    assert rows >= 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).first()["comparable"] == 669
