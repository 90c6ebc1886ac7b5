"""Driver contract: entry runs; every oracle belongs to a registered query."""

from __future__ import annotations

import __spark_entry__ as entry
from conftest import SF_SMALL


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and set(df.columns) >= {"region", "total_volume", "pct_of_total"}


def test_oracles_subset_of_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 60


def test_cheap_queries_run_at_small_scale(spark):
    q = entry.queries()
    for name in ("kpi_row", "external_panel", "pearson_matrix", "scenario_projection", "split_sizes"):
        assert q[name](spark, SF_SMALL).count() > 0
