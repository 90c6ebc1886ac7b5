"""Queries: robust regressions, elasticity, causal effect, VIF."""

from __future__ import annotations

from ledgerlens.operators import panel as PN
from ledgerlens.operators import audit as AU
from ledgerlens.operators import regress as RG
from ledgerlens.operators.features import add_engineered_features
from ledgerlens.plans.catalogue import facts, register
from ledgerlens.plans.oracle import SPEC, with_sales

ELASTICITY_SQL = with_sales("""
SELECT ROUND(b1, 6) AS elasticity, ROUND(sqrt(v11), 6) AS std_err,
       ROUND(b1 - 1.959963984540054 * sqrt(v11), 6) AS ci_low, ROUND(b1 + 1.959963984540054 * sqrt(v11), 6) AS ci_high,
       CAST(n AS BIGINT) AS n_obs
FROM (
  SELECT b1, n, (s22 / det) * (s22 / det) * m11 + 2 * (s22 / det) * (-s12 / det) * m12 + (s12 / det) * (s12 / det) * m22
         AS v11
  FROM b, (SELECT sum(t1 * t1 * w) AS m11, sum(t1 * t2 * w) AS m12, sum(t2 * t2 * w) AS m22
           FROM (SELECT t1, t2, (ty - b1 * t1 - b2 * t2) * (ty - b1 * t1 - b2 * t2)
                            / ((1 - h) * (1 - h)) AS w
                 FROM (SELECT z.*, b.b1, b.b2,
                              1.0 / ng + (t1 * (s22 * t1 - s12 * t2) + t2 * (s11 * t2 - s12 * t1)) / det AS h
                       FROM z, b) r) q) mt
) fin""", features=True, extra_ctes="""
d AS (SELECT Region, ln(CAST(Sales_Volume AS DOUBLE)) AS y, log_price AS x1, CAST(vehicle_age AS DOUBLE) AS x2
      FROM feat WHERE Sales_Volume > 0),
g AS (SELECT Region, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, COUNT(*) AS ng FROM d GROUP BY Region),
z AS (SELECT d.y - g.my AS ty, d.x1 - g.m1 AS t1, d.x2 - g.m2 AS t2, g.ng FROM d JOIN g USING (Region)),
s AS (SELECT sum(t1 * t1) AS s11, sum(t1 * t2) AS s12, sum(t2 * t2) AS s22, sum(t1 * ty) AS s1y,
             sum(t2 * ty) AS s2y, COUNT(*) AS n FROM z),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2,
             s11, s12, s22, n, s11 * s22 - s12 * s12 AS det FROM s)""")

register("price_elasticity_hc3", "J1 J2 J5 B3 B11", ELASTICITY_SQL)(
    lambda spark, d: RG.price_elasticity(facts(spark, d), SPEC).select(
        "elasticity", "std_err", "ci_low", "ci_high", "n_obs")
)
# Two-sided normal p: 2·(1 − Φ(|z|)), Φ(x) = 1/2 + φ(x)·Σ_n x^(2n+1)/(2n+1)!!, with
# (2n+1)!! = 2^(n+1)·Γ(n + 3/2)/√π.
_REPORT_HEAD = """SELECT ROUND(b1, 6) AS elasticity, ROUND(se, 6) AS std_err, ROUND(p, 6) AS p_value,
       ROUND(b1 - 1.959963984540054 * se, 6) AS ci_low, ROUND(b1 + 1.959963984540054 * se, 6) AS ci_high,
       CAST(n AS BIGINT) AS n_obs, p < 0.05 AS is_significant,
       CASE WHEN p < 0.05 THEN printf('Volume reacts %s than proportionally to price (elasticity %+.3f).',
                                      CASE WHEN abs(b1) > 1 THEN 'more' ELSE 'less' END, b1)
            ELSE 'The interval includes zero: these rows do not show that volume reacts to price.'
       END AS interpretation
FROM (SELECT b1, n, se, CASE WHEN az = 0 THEN 1.0 ELSE greatest(0.0, 2.0 * (0.5 - exp(-az * az / 2.0) / sqrt(2 * pi())
             * (SELECT sum(exp((2 * s.k + 1) * ln(az) - (s.k + 1) * ln(2.0) - lgamma(s.k + 1.5) + 0.5 * ln(pi())))
                FROM (SELECT unnest(generate_series(0, 400)) AS k) s))) END AS p
      FROM (SELECT b1, n, sqrt(v11) AS se, abs(b1 / sqrt(v11)) AS az FROM ("""
_HEAD = """SELECT ROUND(b1, 6) AS elasticity, ROUND(sqrt(v11), 6) AS std_err,
       ROUND(b1 - 1.959963984540054 * sqrt(v11), 6) AS ci_low, ROUND(b1 + 1.959963984540054 * sqrt(v11), 6) AS ci_high,
       CAST(n AS BIGINT) AS n_obs
FROM ("""
_ELAST_REPORT_SQL = ELASTICITY_SQL.replace(_HEAD, _REPORT_HEAD).rstrip() + ") zz) pz"
register("price_elasticity_report", "J5", _ELAST_REPORT_SQL)(
    lambda spark, d: RG.price_elasticity(facts(spark, d), SPEC))

NAIVE_SQL = with_sales("""
SELECT ROUND(b, 6) AS naive_effect, ROUND(sqrt(sum(dx * dx * e * e / ((1 - h) * (1 - h)))) / max(sxx), 6)
         AS naive_std_err
FROM (SELECT dx, b, sxx, (y - my) - b * dx AS e, 1.0 / n + dx * dx / sxx AS h
      FROM (SELECT ln(CAST(Sales_Volume AS DOUBLE)) AS y, log_price - mx AS dx, my, n, sxx, b
            FROM feat, (SELECT avg(log_price) AS mx, avg(ln(CAST(Sales_Volume AS DOUBLE))) AS my, COUNT(*) AS n,
                               var_pop(log_price) * COUNT(*) AS sxx,
                               covar_pop(log_price, ln(CAST(Sales_Volume AS DOUBLE))) / var_pop(log_price) AS b
                        FROM feat WHERE Sales_Volume > 0) st
            WHERE Sales_Volume > 0) t) r
GROUP BY b""", features=True)

register("causal_naive_effect", "J6 J1", NAIVE_SQL)(
    lambda spark, d: RG.causal_price_effect(facts(spark, d), SPEC).select("naive_effect", "naive_std_err")
)
register("causal_price_effect", "J6")(lambda spark, d: RG.causal_price_effect(facts(spark, d), SPEC))

VIF3 = [SPEC.engine, SPEC.mileage, "log_price"]


def _vif3_sql() -> str:
    a, b, c = VIF3
    r = lambda x, y: f"corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))"
    det = (f"(1 - {r(a, b)}^2 - {r(a, c)}^2 - {r(b, c)}^2 + 2 * {r(a, b)} * {r(a, c)} * {r(b, c)})")
    return with_sales(
        f"SELECT '{a}' AS feature, ROUND((1 - {r(b, c)}^2) / {det}, 6) AS vif FROM feat UNION ALL "
        f"SELECT '{b}', ROUND((1 - {r(a, c)}^2) / {det}, 6) FROM feat UNION ALL "
        f"SELECT '{c}', ROUND((1 - {r(a, b)}^2) / {det}, 6) FROM feat",
        features=True,
    )


register("vif_three_columns", "J7", _vif3_sql())(
    lambda spark, d: RG.vif_table(add_engineered_features(facts(spark, d), SPEC), VIF3, digits=6)
)
VIF_DEFAULT = [SPEC.engine, SPEC.mileage, "vehicle_age", "log_price", "log_mileage", "price_per_litre_engine"]
register("vif_default_columns", "J7")(
    lambda spark, d: RG.vif_table(add_engineered_features(facts(spark, d), SPEC), VIF_DEFAULT)
)


def _hedonic(spark, d):
    res = RG.hedonic_price_model(facts(spark, d), SPEC)
    return res.coefficients(spark)


register("hedonic_coefficients", "J3 J2 J8")(_hedonic)


def _enriched(spark, d):
    f = facts(spark, d)
    panel, fuel, _ = PN.build_external_panel(f, SPEC)
    return PN.enrich(f, SPEC, panel, fuel)


def _econometric_summary(spark, d):
    f = facts(spark, d)
    models = [RG.hedonic_price_model(f, SPEC), RG.demand_model(_enriched(spark, d), SPEC)]
    return RG.stack_fit_stats(models, spark)


register("econometric_summary", "J4 J8 J9")(_econometric_summary)


def _econometric_report(spark, d):
    """Both fits, the elasticity, the inflation factors and the leak, as (section, item, value)."""
    f = facts(spark, d)
    rows = []
    for fit in (RG.hedonic_price_model(f, SPEC), RG.demand_model(_enriched(spark, d), SPEC)):
        rows += [(fit.name, k, v) for k, v in (("n_obs", fit.n), ("rank", fit.rank), ("r2", fit.r2), ("f_stat", fit.f_stat), ("f_pvalue", fit.f_pvalue))]
    e = RG.price_elasticity(f, SPEC).first()
    rows += [("Elasticity", k, e[k]) for k in ("elasticity", "std_err", "p_value", "ci_low", "ci_high")]
    rows += [("Inflation factors", r.feature, r.vif) for r in RG.vif_table(add_engineered_features(f, SPEC), VIF_DEFAULT).collect()]
    leak = AU.prove_leakage(f, SPEC).first()
    rows += [("Leaked label", k, leak[k]) for k in ("threshold", "accuracy")]
    clean = [(a, b, None if v is None or v != v else float(v)) for a, b, v in rows]
    return spark.createDataFrame(clean, "section string, item string, value double")


register("econometric_report", "J9 J3 J4 J5 J7 I6")(_econometric_report)


def _attr_naive(spark, d):
    data = RG.positive_log_target(add_engineered_features(facts(spark, d), SPEC), SPEC)
    res = RG.ols_hc3(data, "log_volume", ["log_price"], name="naive")
    out = RG.linear_attribution(data, "log_volume", ["log_price"], res)
    from pyspark.sql import functions as F

    return out.select("feature", F.round("mean_abs_attribution", 9).alias("mean_abs_attribution"))


register(
    "linear_attribution_naive", "K15 H8",
    with_sales("""
SELECT 'log_price' AS feature, ROUND(avg(abs(b * (log_price - mx))), 9) AS mean_abs_attribution
FROM feat, (SELECT covar_pop(log_price, ln(CAST(Sales_Volume AS DOUBLE))) / var_pop(log_price) AS b,
                   avg(log_price) AS mx FROM feat WHERE Sales_Volume > 0) st
WHERE Sales_Volume > 0""", features=True),
)(_attr_naive)


def _attr_synthetic(spark, d):
    data = AU.signal_bearing_target(facts(spark, d), SPEC)
    terms = [f"C({SPEC.region})", "is_premium_tier", SPEC.engine, SPEC.year, SPEC.price, "is_electrified"]
    res = RG.ols_hc3(data, "synthetic_demand", terms, name="synthetic")
    return RG.linear_attribution(data, "synthetic_demand", terms, res)


register("linear_attribution_synthetic", "K15 H8")(_attr_synthetic)


def _absorbed(spark, d):
    """Log price on engine size with every colour absorbed."""
    from pyspark.sql import functions as F

    fit = RG.ols_absorbed(add_engineered_features(facts(spark, d), SPEC), "log_price", [SPEC.engine], [SPEC.color])
    row = spark.createDataFrame([(fit.n, fit.df_resid, float(fit.coef[0]), float(fit.std_err()[0]), fit.r2)], "n_obs long, df_resid long, coef double, std_err double, r2 double")
    return row.select("n_obs", "df_resid", *[F.round(c, 9).alias(c) for c in ("coef", "std_err", "r2")])


register("absorbed_engine_slope", "J2 J1", with_sales("""
SELECT COUNT(*) AS n_obs, COUNT(*) - 1 - (SELECT COUNT(*) FROM g) AS df_resid, ROUND(max(b), 9) AS coef,
       ROUND(sqrt(sum(dx * dx * (dy - b * dx) * (dy - b * dx) / ((1 - 1.0 / n - dx * dx / sxx) * (1 - 1.0 / n - dx * dx / sxx)))) / max(sxx), 9) AS std_err,
       ROUND(1 - sum((dy - b * dx) * (dy - b * dx)) / max(sst), 9) AS r2
FROM t, (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS sxx FROM t) s, (SELECT var_pop(log_price) * COUNT(*) AS sst FROM feat) v""",
    features=True, extra_ctes="""
g AS (SELECT Color, avg(Engine_Size_L) AS mx, avg(log_price) AS my, CAST(COUNT(*) AS DOUBLE) AS n FROM feat GROUP BY Color),
t AS (SELECT feat.Engine_Size_L - g.mx AS dx, feat.log_price - g.my AS dy, g.n FROM feat JOIN g USING (Color))"""))(_absorbed)
