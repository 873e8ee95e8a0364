"""Registered queries against their SQL on the smallest tables (the full comparison is tools/compare.py)."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import NAMES, canonical  # noqa: E402

DATA = "/root/testdata/sf0.001"
PICKED = [
    "calendar_sessions", "eligible_session", "bars_30m", "asof_join", "next_bar", "interval_common", "rule_truth", "equal_allocation", "gate_spaced_bars",
    "sma_cross_fills", "limit_fills", "fifo_slices", "performance_metrics", "failure_histogram", "run_digests", "request_intake", "run_assessment", "plan_lint", "threshold_hits",
]


@pytest.fixture(scope="module")
def con():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, con, name):
    rows = entry.queries()[name](spark, DATA).toPandas()
    expected = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(rows.columns) == sorted(expected.columns)
    assert canonical(rows) == canonical(expected)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
