"""Audit statistics and robust regression against brute force (I*, J*)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import audit as AU
from ledgerlens.operators import regress as RG


def test_leakage_found_at_threshold(sample_sales, spec):
    r = AU.detect_leakage(sample_sales, spec).first()
    assert r.leakage_detected and r.threshold == 7000
    proof = AU.prove_leakage(sample_sales, spec).first()
    assert proof.accuracy == 1.0 and proof.separable


def test_leakage_empty_class_is_guarded(sample_sales, spec):
    only_low = sample_sales.where(F.col(spec.label) == "Low")
    assert AU.prove_leakage(only_low, spec).first().threshold is None


def test_no_signal_on_random_frame(sample_sales, spec):
    m = AU.max_abs_offdiag(AU.pearson_matrix(sample_sales, spec.numeric)).first()
    assert m.max_abs_r < 0.1
    anova = AU.anova_by_category(sample_sales, spec.categorical, spec.volume).collect()
    assert all(0 < r.p_value <= 1 for r in anova)


def test_anova_matches_numpy(sample_sales, sample_pdf, spec):
    got = {r.feature: r.f_stat for r in AU.anova_by_category(sample_sales, ["Region"], spec.volume).collect()}
    groups = [g["Sales_Volume"].to_numpy(float) for _, g in sample_pdf.groupby("Region")]
    allv = np.concatenate(groups)
    ssb = sum(len(g) * (g.mean() - allv.mean()) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    f = (ssb / (len(groups) - 1)) / (ssw / (len(allv) - len(groups)))
    assert got["Region"] == pytest.approx(f, rel=1e-9)


def test_ks_rows_and_pvalues(sample_sales, spec):
    rows = AU.ks_uniform(sample_sales, spec.numeric).collect()
    assert len(rows) == 5 and all(0 <= r.p_value <= 1 for r in rows)


def test_chi2_with_yates_matches_hand(spark):
    # 2x2 table [[10, 20], [30, 40]]
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    df = spark.createDataFrame(rows, "p string, q string")
    got = AU.chi2_independence(df, "p", "q").first()
    o = np.array([[10, 20], [30, 40]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    d = np.abs(o - e)
    exp = (((d - np.minimum(0.5, d)) ** 2) / e).sum()
    assert got.dof == 1 and got.chi2 == pytest.approx(exp, rel=1e-6) and 0 <= got.p_value <= 1


def test_mutual_information_detects_dependence(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 5000)
    pdf = pd.DataFrame({"c": x.astype(str), "noise": rng.random(5000), "y": x * 10.0 + rng.random(5000)})
    mi = {r.feature: r.mi for r in AU.mutual_information(spark.createDataFrame(pdf), ["noise"], ["c"], "y").collect()}
    assert mi["c"] > 0.5 > mi["noise"]


def test_synthetic_target_carries_signal(sample_sales, spec):
    syn = AU.signal_bearing_target(sample_sales, spec)
    prem = syn.groupBy("is_premium_tier").agg(F.avg("synthetic_demand").alias("m")).collect()
    m = {r.is_premium_tier: r.m for r in prem}
    assert m[1] > m[0]
    assert syn.where("synthetic_demand < 100").count() == 0


def _hc3_numpy(x, y):
    xtx_inv = np.linalg.inv(x.T @ x)
    b = xtx_inv @ x.T @ y
    e = y - x @ b
    h = np.einsum("ij,jk,ik->i", x, xtx_inv, x)
    meat = (x * (e ** 2 / (1 - h) ** 2)[:, None]).T @ x
    return b, np.sqrt(np.diag(xtx_inv @ meat @ xtx_inv))


def test_ols_hc3_matches_numpy(spark):
    rng = np.random.default_rng(5)
    n = 800
    pdf = pd.DataFrame({"x1": rng.normal(size=n), "x2": rng.normal(size=n) * 3, "g": rng.choice(["a", "b", "c"], n)})
    pdf["y"] = 1 + 2 * pdf.x1 - 0.5 * pdf.x2 + (pdf.g == "b") * 0.7 + rng.normal(size=n) * (1 + np.abs(pdf.x1))
    res = RG.ols_hc3(spark.createDataFrame(pdf).repartition(3), "y", ["C(g)", "x1", "x2"])
    x = np.column_stack([np.ones(n), pdf.g == "b", pdf.g == "c", pdf.x1, pdf.x2]).astype(float)
    b, se = _hc3_numpy(x, pdf.y.to_numpy())
    assert res.terms == ["Intercept", "C(g)[T.b]", "C(g)[T.c]", "x1", "x2"]
    assert np.allclose(res.coef, b, rtol=1e-8) and np.allclose(res.std_err(), se, rtol=1e-6)


def test_injected_price_effect_is_found(spark, sample_pdf, spec):
    rng = np.random.default_rng(1)
    pdf = sample_pdf.copy()
    pdf["Sales_Volume"] = np.clip(9000 - 0.05 * pdf["Price_USD"] + rng.normal(0, 50, len(pdf)), 100, 9999).astype(int)
    pdf["row_key"] = [str(i) for i in range(len(pdf))]
    res = RG.causal_price_effect(spark.createDataFrame(pdf), spec).first()
    assert res.adjusted_effect < -0.05 and res.adjusted_pvalue < 0.05 and res.is_causal


def test_null_effect_on_random_data(sample_sales, spec):
    res = RG.causal_price_effect(sample_sales, spec).first()
    assert not res.is_causal


def test_vif_independent_columns_near_one(sample_sales, spec):
    v = {r.feature: r.vif for r in RG.vif_table(sample_sales, [spec.engine, spec.mileage, spec.price]).collect()}
    assert all(0.99 < x < 1.05 for x in v.values())


def test_f_of_a_collinear_design_equals_the_reduced_one(spark):
    rng = np.random.default_rng(9)
    n = 900
    x, z = rng.normal(size=n), rng.integers(0, 4, n)
    pdf = pd.DataFrame({"x": x, "x2": 3.0 - 2.0 * x, "z": z.astype(str), "y": 1e6 + rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    full = RG.ols_hc3(df, "y", ["C(z)", "x", "x2"])
    reduced = RG.ols_hc3(df, "y", ["C(z)", "x"])
    assert full.rank == reduced.rank == 5 and full.df_model == reduced.df_model == 4
    assert full.f_stat == pytest.approx(reduced.f_stat, rel=1e-8) and full.r2 == pytest.approx(reduced.r2, rel=1e-8)
    assert full.f_pvalue > 0.001


def test_full_leverage_reports_null_errors(spark):
    pdf = pd.DataFrame({"z": ["a"] * 20 + ["b"] * 20 + ["only"], "y": np.arange(41.0)})
    res = RG.ols_hc3(spark.createDataFrame(pdf), "y", ["C(z)"])
    row = res.fit_stats(spark).first()
    assert row.n_high_leverage == 1 and row.f_stat is None
    assert all(r.std_err is None for r in res.coefficients(spark).collect())


def test_vif_of_a_constant_column_is_null(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200), "c": np.ones(200)})
    vif = {r.feature: r.vif for r in RG.vif_table(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    assert vif["c"] is None and vif["a"] == pytest.approx(1, abs=0.1)


def test_findings_on_a_frame_without_signal(sample_sales, spec):
    found = {r.title: r for r in AU.integrity_findings(sample_sales, spec).collect()}
    assert found["any association"].verdict == "NO SIGNAL" and found["leaked label"].verdict == "LEAKAGE"
    assert f"columns: {len(spec.fact_columns)};" in found["structure"].detail


def test_chi2_of_uneven_cells_matches_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.choice(list("pqrst"), 400, p=[0.6, 0.2, 0.1, 0.07, 0.03]), "b": rng.choice(list("uvwxyz"), 400)})
    pdf = pdf[~((pdf.a == "t") & (pdf.b == "u"))]
    got = AU.chi2_independence(spark.createDataFrame(pdf), "a", "b").first()
    table = pd.crosstab(pdf.a, pdf.b).to_numpy(float)
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert got.chi2 == pytest.approx(((table - e) ** 2 / e).sum(), abs=1e-6)


def test_quantile_bins_keep_ties_together_and_bear_an_outlier(spark):
    from ledgerlens.operators import audit as AU

    rng = np.random.default_rng(9)
    x = rng.integers(0, 40, 2000).astype(float)
    pdf = pd.DataFrame({"x": x, "far": np.where(np.arange(2000) == 7, 1e300, x), "y": x * 2 + rng.normal(size=2000)})
    df = spark.createDataFrame(pdf)
    edges = AU.quantile_edges(df, ["x", "far"], 8)
    ordered = np.sort(x)
    assert edges["x"] == sorted({ordered[math.ceil(2000 * k / 8) - 1] for k in range(1, 8)}) and len(edges["far"]) == 7
    got = {r.feature: r.mi for r in AU.mutual_information(df, ["x", "far"], [], "y", bins=8).collect()}
    bx = sum((x > e).astype(int) for e in edges["x"])
    ey = sorted({np.sort(pdf["y"])[math.ceil(2000 * k / 8) - 1] for k in range(1, 8)})
    by = sum((pdf["y"].to_numpy() > e).astype(int) for e in ey)
    joint = np.zeros((8, 8))
    np.add.at(joint, (bx, by), 1 / 2000)
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.nansum(joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True)))
    assert got["x"] == pytest.approx(want, abs=1e-8) and got["far"] > 0.9 * got["x"]


@pytest.mark.parametrize("absorb", [["g"], ["g", "h"]])
def test_absorbed_factors_equal_the_dummy_fit(spark, absorb):
    rng = np.random.default_rng(12)
    n = 600
    pdf = pd.DataFrame({"g": rng.integers(0, 15, n).astype(str), "h": rng.integers(0, 7, n).astype(str), "x": rng.normal(size=n) * 3 + 50, "z": rng.normal(size=n)})
    pdf["x"] += pdf["g"].astype(int)
    pdf["y"] = 2 * pdf["x"] - pdf["z"] + 3 * pdf["g"].astype(int) - 2 * pdf["h"].astype(int) + rng.normal(size=n) * (1 + pdf["z"].abs())
    df = spark.createDataFrame(pdf).repartition(3)
    got = RG.ols_absorbed(df, "y", ["x", "z"], absorb)
    want = RG.ols_hc3(df, "y", ["x", "z", *[f"C({c})" for c in absorb]])
    at = [want.terms.index("x"), want.terms.index("z")]
    assert got.coef == pytest.approx(want.coef[at], rel=1e-8) and got.r2 == pytest.approx(want.r2, rel=1e-8)
    assert (got.n, got.rank, got.df_resid) == (want.n, want.rank, want.df_resid)
    if len(absorb) == 1:
        assert got.std_err() == pytest.approx(want.std_err()[at], rel=1e-7)
    else:
        assert got.std_err() == pytest.approx(want.std_err()[at], rel=0.1)


def test_absorbed_factor_of_more_levels_than_dummies_allow(spark):
    rng = np.random.default_rng(13)
    g = np.repeat(np.arange(1500), 3)
    x = rng.normal(size=len(g))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": 4 * x + g * 0.5 + rng.normal(size=len(g)) * 0.1}))
    with pytest.raises(ValueError):
        RG.ols_hc3(df, "y", ["x", "C(g)"])
    fit = RG.ols_absorbed(df, "y", ["x"], ["g"])
    within = x - x.reshape(-1, 3).mean(1).repeat(3)
    assert fit.coef[0] == pytest.approx(4, abs=0.02) and fit.df_resid == len(g) - 1501
    # a row's leverage is a third, so HC3 weighs a squared residual of expectation 2/3 by 9/4
    assert fit.std_err()[0] == pytest.approx(0.1 * math.sqrt(1.5) / np.sqrt((within**2).sum()), rel=0.1)
