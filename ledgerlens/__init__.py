"""ledgerlens — sales analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame. The core work runs on
Spark (joins, grouping, windows, shuffles); small per-partition numeric helpers
run in ``mapInPandas`` where a closed form needs matrix algebra.

Sub-packages
------------
sources    loading, schema checks, the TPC-H fact adapter, JSON payloads, sinks
operators  reports, profile, features, panel, audit, regression, learning, scenarios
functions  column-expression helpers (hash randomness, binning) and scalar tails
plans      the named query catalogue and its DuckDB oracle SQL
"""

from ledgerlens.session import checkpoint_dir, get_session
from ledgerlens.spec import REFERENCE_SPEC, TPCH_SPEC, TableSpec

__all__ = ["REFERENCE_SPEC", "TPCH_SPEC", "TableSpec", "checkpoint_dir", "get_session"]
