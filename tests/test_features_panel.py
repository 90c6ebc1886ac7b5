"""Features, external panel, enrichment, gap fill, provenance (B3–B15, C*, E3–E5, L*)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.operators import panel as PN
from ledgerlens.spec import ENGINEERED_CATEGORICAL, ENGINEERED_NUMERIC


def test_engineered_columns(sample_sales, spec):
    out = FE.add_engineered_features(sample_sales, spec)
    assert set(ENGINEERED_NUMERIC + ENGINEERED_CATEGORICAL) <= set(out.columns)
    pdf = out.toPandas()
    assert (pdf["vehicle_age"] >= 0).all()
    assert np.allclose(pdf["log_price"], np.log(pdf["Price_USD"].astype(float)))
    assert np.allclose(pdf["log_mileage"], np.log1p(pdf["Mileage_KM"].astype(float)))
    assert (pdf["is_electrified"] == pdf["Fuel_Type"].isin(["Hybrid", "Electric"]).astype(int)).all()


def test_leakage_toggle(spec):
    assert spec.volume not in FE.feature_columns(spec)["numeric"]
    assert spec.volume in FE.feature_columns(spec, include_leakage=True)["numeric"]


def test_zero_engine_gives_null(spark, spec):
    df = spark.createDataFrame([(10.0, 0.0)], "Price_USD double, Engine_Size_L double")
    assert df.select(F.try_divide("Price_USD", "Engine_Size_L").alias("x")).first().x is None


def test_panel_invariants(sample_sales, spec):
    window = PN.PanelWindow(2010, 2024)
    panel, fuel, prov = PN.build_external_panel(sample_sales, spec, window)
    pdf = panel.toPandas()
    assert len(pdf) == 3 * 15
    assert (pdf.loc[pdf.currency == "USD", "usd_per_unit"] == 1.0).all() or "USD" not in set(pdf.currency)
    assert (pdf["co2_emissions_pc"] > 0).all()
    for _, g in pdf.sort_values("year").groupby("region"):
        s = g["regulation_stringency_index"].to_numpy()
        assert s[-1] > s[0]
    again = PN.build_external_panel(sample_sales, spec, window)[0].toPandas()
    assert pdf.sort_values(["region", "year"]).reset_index(drop=True).equals(
        again.sort_values(["region", "year"]).reset_index(drop=True))
    assert {r.source for r in prov.collect()} == set(PN.PANEL_SOURCES)


def test_enrichment_keeps_rows_and_fills(sample_sales, spec):
    panel, fuel, _ = PN.build_external_panel(sample_sales, spec, PN.PanelWindow(2010, 2024))
    out = PN.enrich(sample_sales, spec, panel, fuel)
    assert out.count() == sample_sales.count()
    added = ["inflation_pct", "gdp_per_capita_usd", "usd_per_unit", "price_usd_per_litre"]
    assert out.where(" OR ".join(f"{c} IS NULL" for c in added)).count() == 0


def test_enrichment_rejects_duplicate_keys(sample_sales, spec):
    panel, fuel, _ = PN.build_external_panel(sample_sales, spec, PN.PanelWindow(2010, 2024))
    with pytest.raises(ValueError, match="not unique"):
        PN.enrich(sample_sales, spec, panel.unionByName(panel.limit(1)), fuel)


def test_region_reference_unknown(spark, spec):
    df = spark.createDataFrame([("Atlantis",)], "Region string")
    with pytest.raises(KeyError):
        PN.region_reference(df, "Region", spec)


def test_gap_fill_forward_then_backward(spark):
    obs = spark.createDataFrame([("r", 2012, 1.0), ("r", 2014, 3.0)], "region string, year int, v double")
    out = {r.year: r.v for r in PN.gap_fill(obs, ["region"], ["v"], PN.PanelWindow(2010, 2016)).collect()}
    assert out == {2010: 1.0, 2011: 1.0, 2012: 1.0, 2013: 1.0, 2014: 3.0, 2015: 3.0, 2016: 3.0}


def test_precedence_and_provenance(spark):
    landed = spark.createDataFrame(
        [("wb", "Asia", 2015, 1.0, "mock"), ("wb", "Asia", 2015, 2.0, "live"), ("wb", "Asia", 2016, 3.0, "mock"),
         ("fx", "Asia", 2015, 4.0, "cache"), ("fx", "Asia", 2015, 5.0, "live"), ("fx", "Asia", 2015, 6.0, "mock")],
        "source string, region string, year int, value double, provenance string")
    best = {(r.source, r.year): (r.value, r.provenance)
            for r in PN.resolve_precedence(landed, ["source", "region", "year"]).collect()}
    assert best[("wb", 2015)] == (2.0, "live") and best[("wb", 2016)] == (3.0, "mock")
    assert best[("fx", 2015)] == (4.0, "cache")  # an earlier answer is taken before a new one is fetched
    landed = landed.where("value <> 6.0")
    weakest = {r.source: r.provenance for r in PN.weakest_provenance(landed).collect()}
    assert weakest == {"wb": "mock", "fx": "cache"}
    summary = {r.provenance: r.sources for r in PN.provenance_summary(landed).collect()}
    assert summary["mock"] == "wb"


def test_macro_defaults_fallbacks(sample_sales, spec):
    panel, fuel, _ = PN.build_external_panel(sample_sales, spec, PN.PanelWindow(2010, 2024))
    d = PN.macro_defaults(panel, fuel, 2024).collect()
    assert len(d) == 3 and all(r.fuel_price_usd_per_litre > 0 for r in d)
