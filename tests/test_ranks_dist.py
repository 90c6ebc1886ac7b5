"""Distributed ranks against brute force; scalar tails against table values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import dist
from ledgerlens.operators.ranks import cumulative_counts, exact_percentiles, order_statistics


def _skewed(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    # one hot group holding about a third of the rows, heavy ties
    g = np.where(rng.random(n) < 0.35, "hot", rng.choice(["a", "b", "c", "d"], n))
    v = rng.integers(0, 50, n).astype(float)
    return pd.DataFrame({"g": g, "v": v}), spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))


def test_cumulative_counts_match_bruteforce(spark):
    pdf, df = _skewed(spark)
    got = cumulative_counts(df, ["g"], "v", num_partitions=7).toPandas().sort_values(["g", "v"])
    exp = pdf.groupby(["g", "v"]).size().rename("k").reset_index().sort_values(["g", "v"])
    exp["cum"] = exp.groupby("g")["k"].cumsum()
    assert got[["g", "v", "k", "cum"]].reset_index(drop=True).equals(exp.reset_index(drop=True)[["g", "v", "k", "cum"]])


def test_cumulative_counts_one_value_per_row(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v")
    got = cumulative_counts(df, [], "v", num_partitions=5, unique_values=True).toPandas().sort_values("v")
    assert (got["cum"].to_numpy() == np.arange(1, 1001)).all()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_percentiles_match_numpy(spark, q):
    pdf, df = _skewed(spark, seed=11)
    got = exact_percentiles(df, ["g"], "v", {"x": q}).toPandas().set_index("g")["x"]
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(sub["v"], q))


def test_distribution_tails():
    assert dist.f_sf(4.10, 2, 10) == pytest.approx(0.0501, abs=2e-4)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert dist.normal_two_sided_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert 0.04 < dist.kolmogorov_sf(1.358 / math.sqrt(5000), 5000) < 0.06
    assert math.isnan(dist.f_sf(float("nan"), 1, 2))


def test_tails_at_large_degrees_of_freedom():
    for f, d1 in ((1.01, 24), (0.6, 24), (1.9, 5)):
        limit = dist.chi2_sf(d1 * f, d1)
        assert dist.f_sf(f, d1, 1e12) == pytest.approx(limit, rel=1e-8)
        assert dist.f_sf(f, d1, 1e9) == pytest.approx(limit, rel=1e-6)


@pytest.mark.parametrize("kind", ["double", "long"])
def test_order_statistics_match_sorting(spark, kind):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(0, 6, 700), np.full(90, 2.0), [-5.0]])
    if kind == "long":
        values = (values * 1e6).clip(-9e17, 9e17).astype("int64")
    pdf = pd.DataFrame({"g": ["a" if i % 3 else None for i in range(len(values))], "v": values})
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r for r in order_statistics(df, ["g"], "v", {"lo": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "hi": lambda n: n - 1}).collect()}
    for g in ("a", None):
        ordered = np.sort(values[[(x == g) for x in pdf["g"].where(pdf["g"].notna(), None)]])
        assert (got[g]["n"], got[g]["lo"], got[g]["mid"], got[g]["hi"]) == (len(ordered), ordered[0], ordered[len(ordered) // 2], ordered[-1])


EXTREME = {
    "inf": [1.0, 2.0, 3.0, float("inf")],
    "nan": [1.0, 2.0, float("nan"), 3.0],
    "both": [float("-inf"), -1.0, 0.0, -0.0, float("inf"), float("nan")],
    "wide": [-1.7e308, 1.0, 2.0, 1.7e308],
    "digits": [10.0**-k for k in range(0, 294, 7)],
    "close": [1.0 + k * 2.0**-52 for k in range(50)],
    "negative": [-float(k) ** 3 for k in range(40)],
    "equal": [5.0] * 30,
}


def test_order_statistics_end_on_any_distribution(spark, monkeypatch):
    """Every position of every group, in at most six rounds, whose rows are read once each."""
    from ledgerlens.operators import ranks

    rows = [(g, float(v)) for g, values in EXTREME.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    written = []
    real = ranks.write_shared
    monkeypatch.setattr(ranks, "write_shared", lambda d, name="stage": written.append(name) or real(d, name))
    got = {r["g"]: r for r in order_statistics(df, ["g"], "v", {f"p{i}": lambda n, i=i: (n - 1) * i / 7 for i in range(8)}).collect()}
    assert written.count("codes") == 1 and written.count("select") - 1 <= ranks.SELECT_ROUNDS == 6
    for g, values in EXTREME.items():
        ordered = sorted((float(v) for v in values), key=lambda x: (math.isnan(x), x))
        for i in range(8):
            want = ordered[int((len(ordered) - 1) * i / 7)]
            found = got[g][f"p{i}"]
            assert found == want or (math.isnan(found) and math.isnan(want)), (g, i)


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_order_statistics_of_integers(spark, kind):
    ends = {"int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}[kind]
    values = [*ends, 0, -1, 1, 7, 7, None]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    row = order_statistics(df, [], "v", {f"p{i}": lambda n, i=i: n * 0 + i for i in range(7)}).first()
    assert row["n"] == 7 and [row[f"p{i}"] for i in range(7)] == sorted(v for v in values if v is not None)
    assert order_statistics(df.limit(0), [], "v", {"x": lambda n: n - 1}).count() == 0


def test_percentiles_beside_infinities(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, "inf", "inf", "inf")], "v double")
    row = exact_percentiles(df, [], "v", {"lo": 0.2, "mid": 0.5, "hi": 0.9}).first()
    assert (row["lo"], row["mid"], row["hi"]) == (2.0, math.inf, math.inf)


def test_quantile_sketches_merge_within_their_rank_error(spark):
    from ledgerlens.operators.ranks import approximate_percentiles, merge_sketches, quantile_sketches

    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 20000), "day": rng.integers(0, 9, 20000), "v": np.exp(rng.normal(size=20000) * 3)})
    parts = quantile_sketches(spark.createDataFrame(pdf).repartition(4), ["g", "day"], "v")
    assert parts.count() == 18
    for merged in (merge_sketches(parts, ["g"]), quantile_sketches(spark.createDataFrame(pdf), ["g"], "v")):
        for r in approximate_percentiles(merged, {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect():
            own = np.sort(pdf.loc[pdf["g"] == r["g"], "v"].to_numpy())
            assert r["n"] == len(own)
            for name, q in (("q1", 0.25), ("q2", 0.5), ("q9", 0.9)):
                assert abs(np.searchsorted(own, r[name], side="right") / len(own) - q) < 0.03
