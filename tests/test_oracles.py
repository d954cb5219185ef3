"""A cross-section of the registered queries against their SQL; ``oracle_compare.py`` runs all of them."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "h0_heuristic_score", "g11_matched_titles", "c5_correlated_with", "c8_correlated_score", "p6_beaconing", "e2_decayed_score", "e9_snapshot",
    "m7_spawn_loop", "m15_high_conn_rate", "m22_abuse_events", "i5_threat_intel", "a7_features", "a19_retrain_decisions", "r0_score_events", "k1_alert_lines",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    own = {name for name in queries if not name.startswith("op") and name != "pipeline"}
    assert sorted(own - set(sql)) == []


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "severity_label" in df.columns and df.count() > 0
