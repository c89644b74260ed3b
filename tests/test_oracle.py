"""Named queries against their SQL on the smallest tables.

A cross-section by default; set GAUGELINE_ALL_QUERIES=1 for all of them.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from check_queries import compare, duck

SOME = (
    "src_csv_clean",
    "stage_handoff",
    "describe_readings",
    "anomaly_context",
    "baseline_24h",
    "repeat_length",
    "ensemble_score",
    "neighbor_consensus",
    "spatial_batch",
    "correct_rule",
    "health_ledger",
    "inject_drift_rows",
    "fault_islands",
    "class_report",
    "roc_auc",
    "kpi",
    "stream_kpis",
)
SQL = entry.oracle_sql()
NAMES = tuple(SQL) if os.environ.get("GAUGELINE_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, con.execute(SQL[name]).df()) == "ok"


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
