"""SQL reports, KPIs, profile, reshaping (D*, E1, B1–B2, B16–B19, F*)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import profile as P
from ledgerlens.operators import reports as R
from ledgerlens.plans import catalogue


def test_report_catalogue(spark):
    names = catalogue.list_queries()
    assert len([n for n in names if n in R.REPORTS]) >= 5
    with pytest.raises(KeyError, match="available"):
        catalogue.run_query(spark, "no_such_report", "/tmp")


def test_region_shares_sum_to_100(sample_sales, spec):
    rows = R.top_regions_by_volume(sample_sales, spec).collect()
    assert abs(sum(r.pct_of_total for r in rows) - 100) <= 0.5


def test_percentages_in_range(sample_sales, spec):
    for r in R.high_rate_by_region(sample_sales, spec).collect():
        assert 0 <= r.high_pct <= 100
    for r in R.electrification_by_region(sample_sales, spec).collect():
        assert 0 <= r.electrified_pct <= 100


def test_yoy_first_year_null(sample_sales, spec):
    rows = R.yoy_volume(sample_sales, spec).orderBy("year").collect()
    assert rows[0].yoy_delta is None and rows[0].yoy_pct is None
    assert all(r.yoy_delta is not None for r in rows[1:])


def test_price_quartiles_ordered(sample_sales, spec):
    for r in R.price_stats_by_model(sample_sales, spec).collect():
        assert r.p25_price_usd <= r.median_price_usd <= r.p75_price_usd


def test_slice_empty_selection_means_no_rows(sample_sales, spec):
    assert P.slice_facts(sample_sales, spec, [], ["Petrol"], 2010, 2024).count() == 0
    assert P.slice_facts(sample_sales, spec, ["Asia"], ["Petrol"], 2010, 2024).count() > 0


def test_profile_and_duplicates(sample_sales, spec):
    assert P.duplicate_rows(sample_sales, list(spec.fact_columns)).first().n_duplicates == 0
    doubled = sample_sales.unionByName(sample_sales.limit(5))
    assert P.duplicate_rows(doubled, list(spec.fact_columns)).first().n_duplicates == 5
    nulls = {r.column_name: r.n_null for r in P.null_cells(sample_sales, list(spec.fact_columns)).collect()}
    assert nulls["__total__"] == 0
    prof = {r.column_name: r for r in P.categorical_profile(sample_sales, list(spec.categorical)).collect()}
    assert prof["Transmission"].n_unique == 2 and prof["Transmission"]["count"] == 1500


def test_histogram_counts_all_rows(sample_sales, spec):
    h = P.histogram(sample_sales, spec.price, 40).collect()
    assert len(h) <= 40 and sum(r.n for r in h) == 1500


def test_contingency_zero_filled(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    cells = {(r.p, r.q): r.n for r in P.contingency(df, "p", "q").collect()}
    assert cells == {("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 0}


def test_seeded_sample_reproducible(sample_sales):
    a = [r.row_key for r in P.seeded_sample(sample_sales, "row_key", 50, 42).collect()]
    b = [r.row_key for r in P.seeded_sample(sample_sales.repartition(7), "row_key", 50, 42).collect()]
    assert sorted(a) == sorted(b) and len(a) == 50


def test_unpivot_pivot_roundtrip(sample_sales, spec):
    k = P.kpi_row(sample_sales, spec)
    long = P.unpivot_long(k, [], ["n_rows", "total_volume"])
    assert {r.metric for r in long.collect()} == {"n_rows", "total_volume"}
    wide = P.pivot_wide(long.withColumn("row", F.lit(1)), "row", "metric", "value", ["n_rows"])
    assert wide.first().n_rows == 1500
