"""Queries: correlation, ANOVA, MI, leakage, KS, χ², synthetic target, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import audit as AU
from ledgerlens.plans.catalogue import facts, register
from ledgerlens.plans.oracle import SPEC, case_map, dbl, hash_normal_sql, with_sales
from ledgerlens.spec import (
    SYNTH_BASE, SYNTH_ELECTRIFIED, SYNTH_ENGINE, SYNTH_FLOOR, SYNTH_NOISE_SD, SYNTH_PREMIUM, SYNTH_PRICE,
    SYNTH_YEAR, SYNTH_YEAR0,
)

NUM = list(SPEC.numeric)
CAT = list(SPEC.categorical)
CHI_PAIRS = [(SPEC.model, SPEC.region), (SPEC.fuel, SPEC.transmission), (SPEC.region, SPEC.color)]
YATES_PAIR = (SPEC.transmission, SPEC.label)
MI_BINS = 16


def _pearson_sql() -> str:
    parts = []
    for a in NUM:
        for b in NUM:
            if a == b:
                r = f"CASE WHEN stddev_pop(CAST({a} AS DOUBLE)) > 0 THEN 1.0::DOUBLE END"
            else:
                r = (f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / "
                     f"nullif(stddev_pop(CAST({a} AS DOUBLE)) * stddev_pop(CAST({b} AS DOUBLE)), 0)")
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, ROUND({r}, 9) AS r FROM sales")
    return " UNION ALL ".join(parts)


def _pearson(spark, d):
    m = AU.pearson_matrix(facts(spark, d), NUM)
    return m.select("a", "b", F.round("r", 9).alias("r"))


register("pearson_matrix", "I1", with_sales(_pearson_sql()))(_pearson)


def _max_abs(spark, d):
    out = AU.max_abs_offdiag(AU.pearson_matrix(facts(spark, d), NUM))
    return out.select(F.round("max_abs_r", 9).alias("max_abs_r"), "verdict")


register(
    "max_abs_correlation", "I2",
    with_sales(f"""
SELECT ROUND(max(abs(r)), 9) AS max_abs_r, CASE WHEN max(abs(r)) < 0.05 THEN 'NO SIGNAL' ELSE 'SIGNAL PRESENT' END
  AS verdict FROM ({_pearson_sql().replace('ROUND(', '(').replace(', 9) AS r', ') AS r')}) m WHERE a <> b"""),
)(_max_abs)


def _anova_levels_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, COUNT(*) AS n, AVG(CAST(Sales_Volume AS DOUBLE)) "
        f"AS m, var_pop(CAST(Sales_Volume AS DOUBLE)) AS v FROM sales GROUP BY {c}"
        for c in CAT
    )


register(
    "anova_by_category", "I3",
    with_sales(f"""
SELECT p.feature, p.n_groups, p.n_groups - 1 AS df_between, CAST(p.n_obs - p.n_groups AS BIGINT) AS df_within,
       ROUND(CASE WHEN p.n_groups >= 2 THEN (s.ssb / (p.n_groups - 1)) / nullif(s.ssw / (p.n_obs - p.n_groups), 0) END, 6)
         AS f_stat
FROM (SELECT feature, COUNT(*) AS n_groups, SUM(n) AS n_obs, SUM(n * m) / SUM(n) AS grand FROM lv GROUP BY feature) p
JOIN (SELECT lv.feature, SUM(lv.n * (lv.m - g.grand) * (lv.m - g.grand)) AS ssb, SUM(lv.n * lv.v) AS ssw
      FROM lv JOIN (SELECT feature, SUM(n * m) / SUM(n) AS grand FROM lv GROUP BY feature) g USING (feature)
      GROUP BY lv.feature) s USING (feature)""",
               extra_ctes=f"lv AS (SELECT * FROM ({_anova_levels_sql()}) x WHERE n > 1)"),
)(lambda spark, d: AU.anova_by_category(facts(spark, d), CAT, SPEC.volume, with_p=False).select(
    "feature", "n_groups", "df_between", "df_within", F.round("f_stat", 6).alias("f_stat")))

_ANOVA_SELECT = f"""
SELECT p.feature, p.n_groups, p.n_groups - 1 AS df_between, CAST(p.n_obs - p.n_groups AS BIGINT) AS df_within,
       CASE WHEN p.n_groups >= 2 THEN (s.ssb / (p.n_groups - 1)) / nullif(s.ssw / (p.n_obs - p.n_groups), 0) END
         AS f_raw
FROM (SELECT feature, COUNT(*) AS n_groups, SUM(n) AS n_obs, SUM(n * m) / SUM(n) AS grand FROM lv GROUP BY feature) p
JOIN (SELECT lv.feature, SUM(lv.n * (lv.m - g.grand) * (lv.m - g.grand)) AS ssb, SUM(lv.n * lv.v) AS ssw
      FROM lv JOIN (SELECT feature, SUM(n * m) / SUM(n) AS grand FROM lv GROUP BY feature) g USING (feature)
      GROUP BY lv.feature) s USING (feature)"""


def _anova_p(spark, d):
    out = AU.anova_by_category(facts(spark, d), CAT, SPEC.volume)
    return out.select("feature", "n_groups", "df_between", "df_within", F.round("f_stat", 6).alias("f_stat"),
                      F.round("p_value", 9).alias("p_value"))


# F tail: P(F > f) = 1 − I_y(d1/2, d2/2), y = d1·f/(d2 + d1·f), with
# I_y(p, q) = y^p (1−y)^q / (p·B(p, q)) · Σ_n (p+q)_n / (p+1)_n · y^n.
register(
    "anova_pvalues", "I3",
    with_sales(f"""
SELECT feature, n_groups, df_between, df_within, ROUND(f_raw, 6) AS f_stat,
       ROUND(CASE WHEN f_raw IS NULL THEN NULL WHEN f_raw <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - exp(
             pp * ln(y) + qq * ln(1.0 - y) - ln(pp) - (lgamma(pp) + lgamma(qq) - lgamma(pp + qq)))
             * (SELECT sum(exp(lgamma(pp + qq + s.k) - lgamma(pp + qq) - lgamma(pp + 1 + s.k) + lgamma(pp + 1)
                               + s.k * ln(y)))
                FROM (SELECT unnest(generate_series(0, 20000)) AS k) s))) END, 9) AS p_value
FROM (SELECT *, df_between / 2.0 AS pp, df_within / 2.0 AS qq,
             df_between * f_raw / (df_within + df_between * f_raw) AS y
      FROM ({_ANOVA_SELECT}) a) b""", extra_ctes=f"lv AS (SELECT * FROM ({_anova_levels_sql()}) x WHERE n > 1)"),
)(_anova_p)


def _bin_sql(c: str) -> str:
    return f"CAST(len(list_filter(ed.e_{c}, lambda e: e < CAST({c} AS DOUBLE))) AS INT)"


def _mi_sql() -> str:
    edges = ", ".join(
        f"list_distinct([list_sort(list(CAST({c} AS DOUBLE)))[CAST(ceil(COUNT({c}) * k / CAST({MI_BINS} AS DOUBLE)) AS BIGINT)] for k in range(1, {MI_BINS})]) AS e_{c}"
        for c in NUM)
    y = _bin_sql(SPEC.volume)
    stacked = " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, CAST({_bin_sql(c)} AS VARCHAR) AS x, {y} AS y FROM sales, ed"
         for c in NUM if c != SPEC.volume]
        + [f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS x, {y} AS y FROM sales, ed" for c in CAT]
    )
    return with_sales(
        """
SELECT cl.feature,
       ROUND(SUM((CAST(cl.c AS DOUBLE) / t.n) * ln(CAST(cl.c AS DOUBLE) * t.n / (CAST(px.cx AS DOUBLE) * py.cy))), 9) AS mi,
       ROUND(SUM((CAST(cl.c AS DOUBLE) / t.n) * ln(CAST(cl.c AS DOUBLE) * t.n / (CAST(px.cx AS DOUBLE) * py.cy)))
             - (max(bx.bx) - 1) * (max(by_.by) - 1) / (2.0 * max(t.n)), 9) AS mi_mm
FROM cells cl
JOIN (SELECT feature, x, SUM(c) AS cx FROM cells GROUP BY feature, x) px USING (feature, x)
JOIN (SELECT feature, y, SUM(c) AS cy FROM cells GROUP BY feature, y) py USING (feature, y)
JOIN (SELECT feature, CAST(SUM(c) AS DOUBLE) AS n FROM cells GROUP BY feature) t USING (feature)
JOIN (SELECT feature, COUNT(DISTINCT x) AS bx FROM cells GROUP BY feature) bx USING (feature)
JOIN (SELECT feature, COUNT(DISTINCT y) AS by FROM cells GROUP BY feature) by_ USING (feature)
GROUP BY cl.feature""",
        extra_ctes=f"ed AS (SELECT {edges} FROM sales),\n"
                   f"cells AS (SELECT feature, x, y, COUNT(*) AS c FROM ({stacked}) s WHERE x IS NOT NULL "
                   f"GROUP BY feature, x, y)",
    )


register("mutual_information", "I4 F3", _mi_sql())(
    lambda spark, d: AU.mutual_information(facts(spark, d), [c for c in NUM if c != SPEC.volume], CAT,
                                           SPEC.volume, MI_BINS)
)

register(
    "leakage_detection", "I5 D17",
    with_sales("""
SELECT high_min, low_max, coalesce(high_min > low_max, FALSE) AS leakage_detected,
       CASE WHEN high_min > low_max THEN high_min END AS threshold
FROM (SELECT min(CASE WHEN Sales_Classification = 'High' THEN Sales_Volume END) AS high_min,
             max(CASE WHEN Sales_Classification = 'Low' THEN Sales_Volume END) AS low_max FROM sales) t"""),
)(lambda spark, d: AU.detect_leakage(facts(spark, d), SPEC))

register(
    "leakage_proof", "I6",
    with_sales("""
SELECT t.high_min AS threshold, t.high_min, t.low_max, t.high_min > t.low_max AS separable,
       ROUND(AVG(CASE WHEN (s.Sales_Volume >= t.high_min) = (s.Sales_Classification = 'High') THEN 1.0 ELSE 0.0 END), 6)
         AS accuracy,
       printf('Sales_Volume >= %d alone decides Sales_Classification: the rule is right on %.4f of the rows', t.high_min,
              AVG(CASE WHEN (s.Sales_Volume >= t.high_min) = (s.Sales_Classification = 'High') THEN 1.0 ELSE 0.0 END))
         AS verdict
FROM sales s, (SELECT min(CASE WHEN Sales_Classification = 'High' THEN Sales_Volume END) AS high_min,
                      max(CASE WHEN Sales_Classification = 'Low' THEN Sales_Volume END) AS low_max FROM sales) t
GROUP BY t.high_min, t.low_max"""),
)(lambda spark, d: AU.prove_leakage(facts(spark, d), SPEC))


def _ks_sql() -> str:
    parts = []
    for c in NUM:
        parts.append(f"""
SELECT '{c}' AS feature, max(n) AS n, ROUND(max(greatest(cum / n - (x - lo) / (hi - lo),
                                                       (x - lo) / (hi - lo) - (cum - k) / n)), 9) AS d_stat, max(hi) - max(lo) AS w
FROM (SELECT x, k, CAST(SUM(k) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum,
             CAST(SUM(k) OVER () AS DOUBLE) AS n, lo, hi
      FROM (SELECT CAST({c} AS DOUBLE) AS x, COUNT(*) AS k FROM sales WHERE {c} IS NOT NULL GROUP BY 1) v,
           (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM sales) mm) t""")
    return with_sales("SELECT feature, CAST(n AS BIGINT) AS n, d_stat FROM (" + " UNION ALL ".join(parts)
                      + ") u WHERE w > 0")


register("ks_uniform", "I7 E6", _ks_sql())(
    lambda spark, d: AU.ks_uniform(facts(spark, d), NUM, with_p=False)
)
def _ks_pvalues(spark, d):
    out = AU.ks_uniform(facts(spark, d), NUM)
    return out.select("feature", "n", "d_stat", F.round("p_value", 9).alias("p_value"))


def _ks_p_oracle() -> str:
    body = _ks_sql()
    # _ks_sql() is "WITH sales AS (...)\nSELECT ..."; wrap its final SELECT as a subquery.
    head, select = body.split("\nSELECT feature, CAST(n AS BIGINT) AS n, d_stat FROM (", 1)
    inner = "SELECT feature, CAST(n AS BIGINT) AS n, d_stat FROM (" + select
    return head + f"""
SELECT feature, n, d_stat,
       ROUND(CASE WHEN lam < 1e-3 THEN 1.0 ELSE least(1.0, greatest(0.0,
             (SELECT sum(2.0 * (CASE WHEN s.k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * s.k * s.k * lam * lam))
              FROM (SELECT unnest(generate_series(1, 199)) AS k) s))) END, 9) AS p_value
FROM (SELECT feature, n, d_stat, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d_stat AS lam FROM ({inner}) x) y"""


register("ks_uniform_pvalues", "I7", _ks_p_oracle())(_ks_pvalues)


def _chi2_sql(a: str, b: str, yates: bool) -> str:
    adj = "(abs(o - e) - least(0.5, abs(o - e)))" if yates else "abs(o - e)"
    return f"""
SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(SUM({adj} * {adj} / e), 6) AS chi2,
       CAST((max(r) - 1) * (max(c) - 1) AS INT) AS dof, CAST(max(n) AS BIGINT) AS n
FROM (
  SELECT CAST(coalesce(ct.o, 0) AS DOUBLE) AS o, CAST(ra.ra AS DOUBLE) * cb.cb / t.n AS e, t.n, t.r, t.c
  FROM (SELECT DISTINCT {a} AS a FROM sales) la CROSS JOIN (SELECT DISTINCT {b} AS b FROM sales) lb
  LEFT JOIN (SELECT {a} AS a, {b} AS b, COUNT(*) AS o FROM sales GROUP BY 1, 2) ct ON ct.a = la.a AND ct.b = lb.b
  JOIN (SELECT {a} AS a, COUNT(*) AS ra FROM sales GROUP BY 1) ra ON ra.a = la.a
  JOIN (SELECT {b} AS b, COUNT(*) AS cb FROM sales GROUP BY 1) cb ON cb.b = lb.b
  CROSS JOIN (SELECT CAST(COUNT(*) AS DOUBLE) AS n, COUNT(DISTINCT {a}) AS r, COUNT(DISTINCT {b}) AS c FROM sales) t
) x"""


def _chi2_pairs(spark, d, with_p):
    return AU.chi2_pairs(facts(spark, d), CHI_PAIRS, with_p=with_p)


register("chi2_independence", "I8 D11",
         with_sales(" UNION ALL ".join(_chi2_sql(a, b, False) for a, b in CHI_PAIRS)))(
    lambda spark, d: _chi2_pairs(spark, d, False)
)
def _chi2_pvalues(spark, d):
    out = _chi2_pairs(spark, d, True)
    return out.select("feature_a", "feature_b", "chi2", "dof", "n", F.round("p_value", 9).alias("p_value"))


def _chi2_p_oracle() -> str:
    # Q(dof/2, chi2/2) = 1 − x^s e^(−x) Σ_n x^n / Γ(s + n + 1), the regularised gamma series.
    inner = " UNION ALL ".join(_chi2_sql(a, b, False) for a, b in CHI_PAIRS)
    return with_sales(f"""
SELECT feature_a, feature_b, chi2, dof, n,
       ROUND(CASE WHEN chi2 <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - exp(-(chi2 / 2.0) + (dof / 2.0) * ln(chi2 / 2.0))
             * (SELECT sum(exp(s.k * ln(chi2 / 2.0) - lgamma(dof / 2.0 + s.k + 1)))
                FROM (SELECT unnest(generate_series(0, 2000)) AS k) s)) END, 9) AS p_value
FROM ({inner}) c""")


register("chi2_independence_pvalues", "I8", _chi2_p_oracle())(_chi2_pvalues)
register("chi2_yates_2x2", "I8", with_sales(_chi2_sql(*YATES_PAIR, True)))(
    lambda spark, d: AU.chi2_independence(facts(spark, d), *YATES_PAIR, with_p=False)
)


def _synth_sql() -> str:
    noise = hash_normal_sql("concat_ws(':', row_key, 'synthetic', '42')")
    return with_sales(f"""
SELECT row_key, ROUND(greatest({dbl(SYNTH_BASE)} + {case_map('Region', SPEC.region_effect, 0.0)}
    + {dbl(SYNTH_PREMIUM)} * is_premium_tier + {dbl(SYNTH_ENGINE)} * CAST(Engine_Size_L AS DOUBLE)
    + {dbl(SYNTH_YEAR)} * (Year - {SYNTH_YEAR0}) + {dbl(SYNTH_PRICE)} * CAST(Price_USD AS DOUBLE)
    + {dbl(SYNTH_ELECTRIFIED)} * is_electrified + {dbl(SYNTH_NOISE_SD)} * {noise}, {dbl(SYNTH_FLOOR)}), 6)
  AS synthetic_demand
FROM feat""", features=True)


register("signal_bearing_target", "I10 L5 B14 B15", _synth_sql())(
    lambda spark, d: AU.signal_bearing_target(facts(spark, d), SPEC).select(
        "row_key", F.round("synthetic_demand", 6).alias("synthetic_demand"))
)

register("integrity_findings", "I12 D12 D13 D14")(lambda spark, d: AU.integrity_findings(facts(spark, d), SPEC))
