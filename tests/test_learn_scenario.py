"""Splits, metrics, conformal, CV, permutation; what-if scenarios (K*, I9, M*)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import learn as LN
from ledgerlens.operators import scenario as SC


def test_split_sizes_sum_and_strata(sample_sales, spec):
    df = sample_sales.withColumn("label", (F.col(spec.label) == "High").cast("int"))
    s = LN.assign_split(df, "row_key", stratify="label")
    sizes = {(r.split, r.label): r.n for r in s.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 1500
    for lab in (0, 1):
        n = sum(v for (sp, lb), v in sizes.items() if lb == lab)
        assert sizes[("test", lab)] == int(np.ceil(n * 0.15))


def test_regression_metric_identities(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "y double, p double")
    m = LN.regression_metrics(df, "y", "p").first()
    assert m.r2 == 1.0 and m.rmse == 0.0


def test_classification_metric_identities(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, 0.8)], "y int, s double")
    m = LN.classification_metrics(df, "y", "s").first()
    assert m.roc_auc == 1.0 and m.accuracy == 1.0


def test_auc_with_ties_matches_bruteforce(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600)
    s = np.round(rng.random(600) + 0.3 * y, 1)
    got = LN.roc_auc(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), "y", "s").first().roc_auc
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(exp, rel=1e-12)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert LN.roc_auc(df, "y", "s").first().roc_auc is None


def test_kfold_and_learning_curve(sample_sales, spec):
    df = sample_sales.select("row_key", spec.model, F.col(spec.volume).cast("double").alias("y"))
    folds = LN.kfold_group_mean(df, "row_key", spec.model, "y", k=5).collect()
    assert len(folds) == 5 and sum(r.n for r in folds) == 1500
    lc = LN.learning_curve_group_mean(df, "row_key", spec.model, "y").orderBy("size").collect()
    assert len(lc) == 5 and lc[0].n_train_mean < lc[-1].n_train_mean


def test_permutation_test_no_signal(sample_sales, spec):
    df = sample_sales.select("row_key", spec.model, F.col(spec.volume).cast("double").alias("y"))
    s = LN.assign_split(df, "row_key")
    scores = LN.permutation_test_group_mean(s, "row_key", spec.model, "y", n_perm=10)
    r = LN.permutation_pvalue(scores).first()
    assert 0 < r.p_value <= 1 and r.n_permutations == 10


def test_permutations_rank_by_bytes(sample_sales, spec, monkeypatch):
    """What is sorted and written of a label's place is the digest's 16 bytes, not its 32 letters."""
    seen, ranked = [], LN.cumulative_counts
    monkeypatch.setattr(LN, "cumulative_counts", lambda df, *a, **k: seen.append(dict(df.dtypes)["_h"]) or ranked(df, *a, **k))
    split = LN.assign_split(sample_sales.withColumn("y", F.col(spec.volume).cast("double")), spec.key)
    assert LN.permutation_test_group_mean(split, spec.key, spec.model, "y", n_perm=2).count() == 3
    assert seen == ["binary"]


def test_conformal_coverage(sample_sales, spec):
    df = sample_sales.select("row_key", spec.model, F.col(spec.volume).cast("double").alias("y"))
    roles = LN.conformal_roles(df, "row_key")
    scored = LN.group_mean_predictions(roles.where("role = 'fit'"), roles.where("role <> 'fit'"), spec.model, "y")
    r = LN.split_conformal(scored, "y", "yhat", "role").first()
    assert 0.8 <= r.coverage <= 1.0 and r.relative_width > 0.6 and not r.is_informative


def _one(spark, spec, **kw):
    base = spark.createDataFrame([("Europe", "Petrol", "standard", 5000.0), ("Europe", "Electric", "standard", 5000.0),
                                  ("Europe", "Petrol", "premium", 5000.0)],
                                 "region string, fuel_type string, segment string, base_volume double")
    rows = SC.attach_scenarios(base, [SC.Scenario("s", **kw)])
    return {(r.fuel_type, r.segment): r for r in SC.project(rows, spec).collect()}


def test_scenario_invariants(spark, spec):
    zero = _one(spark, spec)
    assert all(r.projected_volume == 5000.0 for r in zero.values())
    up = _one(spark, spec, price_change_pct=10.0)
    assert up[("Petrol", "standard")].projected_volume < 5000
    assert up[("Petrol", "premium")].projected_volume > up[("Petrol", "standard")].projected_volume
    inc = _one(spark, spec, gdp_growth_pct=10.0)
    assert inc[("Petrol", "standard")].projected_volume > 5000
    reg = _one(spark, spec, regulation_change_pts=20.0)
    assert reg[("Electric", "standard")].projected_volume > 5000 > reg[("Petrol", "standard")].projected_volume
    r = _one(spark, spec, price_change_pct=5.0, gdp_growth_pct=3.0, fuel_price_change_pct=7.0,
             regulation_change_pts=4.0, fx_depreciation_pct=2.0)[("Petrol", "standard")]
    prod = r.price_mult * r.income_mult * r.fuel_mult * r.regulation_mult * r.fx_mult
    assert r.projected_volume == pytest.approx(5000 * prod)


def test_monte_carlo_intervals(spark, spec):
    base = spark.createDataFrame([("Europe", "Petrol", "standard", 5000.0)],
                                 "region string, fuel_type string, segment string, base_volume double")
    rows = SC.attach_scenarios(base, [SC.Scenario("s", price_change_pct=10.0)])
    draws = SC.monte_carlo(rows, spec, n_draws=2000)
    assert draws.count() == 2000
    p = SC.draw_percentiles(draws).first()
    point = SC.project(rows, spec).first().projected_volume
    assert p.p2_5 <= p.p10 <= p.p50 <= p.p90 <= p.p97_5
    assert abs(p.p50 - point) / point < 0.05
    text = SC.narrative(SC.project(rows, spec)).first().narrative
    assert "fall" in text and "what-if" in text


def test_random_search_draws_differ_and_repeat():
    from pyspark.ml.regression import LinearRegression

    est = LinearRegression()
    a, b = LN.random_params(est, "Linear", 6, 1), LN.random_params(est, "Linear", 6, 1)
    assert a == b and len({tuple(x.values()) for x in a}) == 6


def test_moments_equal_row_level_scores(sample_sales, spec):
    pdf = sample_sales.select("row_key", spec.model, F.col(spec.volume).cast("double").alias("y"),
                              LN._fold("row_key", 5, LN.SEED).alias("fold")).toPandas()
    got = {r.fold: r.r2 for r in LN.kfold_group_mean(sample_sales.withColumn("y", F.col(spec.volume).cast("double")), "row_key", spec.model, "y").collect()}
    for f, test in pdf.groupby("fold"):
        means = pdf[pdf.fold != f].groupby(spec.model)["y"].mean()
        e = test["y"] - test[spec.model].map(means)
        assert got[f] == pytest.approx(1 - (e**2).sum() / ((test["y"] - test["y"].mean()) ** 2).sum(), rel=1e-9)
