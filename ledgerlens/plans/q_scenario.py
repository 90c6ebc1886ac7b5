"""Queries: what-if projections, driver effects, Monte-Carlo intervals, narrative."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from ledgerlens.operators import scenario as SC
from ledgerlens.plans.catalogue import facts, register
from ledgerlens.plans.oracle import ELECTRIFIED_SQL, PREMIUM_SQL, SPEC, case_map, dbl, hash_normal_sql, with_sales

KEYS = list(SC.KEYS)
N_DRAWS = SC.N_DRAWS


def _rows(spark, d):
    return SC.attach_scenarios(SC.baselines(facts(spark, d), SPEC), SC.DEFAULT_SCENARIOS)


def _prior_sql(i: int) -> str:
    return case_map("segment", {k: v[i] for k, v in SC.PRIORS.items()}, SC.PRIORS["standard"][i])


def _sd_sql(i: int) -> str:
    return case_map("segment", {k: v[i] for k, v in SC.PRIOR_SD.items()}, SC.PRIOR_SD["standard"][i])


_SCEN_ROWS = " UNION ALL ".join(
    "SELECT '{scenario_id}' AS scenario_id, ".format(**asdict(s))
    + ", ".join(f"{dbl(v)} AS {k}" for k, v in asdict(s).items() if k != "scenario_id")
    for s in SC.DEFAULT_SCENARIOS
)
ELEC = f"(fuel_type IN ({ELECTRIFIED_SQL}))"
ROWS_CTE = f"""
base AS (SELECT Region AS region, Fuel_Type AS fuel_type,
                CASE WHEN Model IN ({PREMIUM_SQL}) THEN 'premium' ELSE 'standard' END AS segment,
                CAST(SUM(Sales_Volume) AS DOUBLE) AS base_volume FROM sales GROUP BY 1, 2, 3),
rows_ AS (SELECT * FROM base CROSS JOIN ({_SCEN_ROWS}) sc),
proj AS (
  SELECT *, base_volume * price_mult * income_mult * fuel_mult * regulation_mult * fx_mult AS projected_volume
  FROM (SELECT *,
          pow(1.0 + price_change_pct / 100.0, {_prior_sql(0)}) AS price_mult,
          pow(1.0 + gdp_growth_pct / 100.0, {_prior_sql(1)}) AS income_mult,
          pow(1.0 + fuel_price_change_pct / 100.0, CASE WHEN {ELEC} THEN {_prior_sql(3)} ELSE {_prior_sql(2)} END)
            AS fuel_mult,
          greatest(1.0 + (CASE WHEN {ELEC} THEN 1.0 ELSE -1.0 END) * {_prior_sql(4)} * (regulation_change_pts / 10.0),
                   0.0) AS regulation_mult,
          pow(1.0 + fx_depreciation_pct / 100.0, {_prior_sql(0)}) AS fx_mult
        FROM rows_) m
)"""

_MULTS = ["price_mult", "income_mult", "fuel_mult", "regulation_mult", "fx_mult"]


def _projection(spark, d):
    p = SC.project(_rows(spark, d), SPEC)
    return p.select(*KEYS, "base_volume", *[F.round(c, 9).alias(c) for c in _MULTS],
                    F.round("projected_volume", 6).alias("projected_volume"),
                    F.round("total_change_pct", 6).alias("total_change_pct"))


register(
    "scenario_projection", "M1 M2",
    with_sales(
        "SELECT scenario_id, region, fuel_type, segment, base_volume, "
        + ", ".join(f"ROUND({c}, 9) AS {c}" for c in _MULTS)
        + ", ROUND(projected_volume, 6) AS projected_volume, "
          "ROUND(CASE WHEN base_volume = 0 THEN 0.0 ELSE (projected_volume / base_volume - 1.0) * 100.0 END, 6) "
          "AS total_change_pct FROM proj",
        extra_ctes=ROWS_CTE.strip()),
)(_projection)

_DRIVER_ROWS = " UNION ALL ".join(
    f"SELECT scenario_id, region, fuel_type, segment, '{dname}' AS driver, {m} AS multiplier, {i} AS pos FROM proj"
    for i, (dname, m) in enumerate(zip(SC.DRIVERS, _MULTS))
)


def _effects(spark, d):
    e = SC.driver_effects(SC.project(_rows(spark, d), SPEC))
    return e.select(*KEYS, "driver", F.round("multiplier", 9).alias("multiplier"),
                    F.round("pct_effect", 6).alias("pct_effect"))


register(
    "scenario_driver_effects", "M3",
    with_sales(f"""
SELECT scenario_id, region, fuel_type, segment, driver, ROUND(multiplier, 9) AS multiplier,
       ROUND((multiplier - 1.0) * 100.0, 6) AS pct_effect FROM ({_DRIVER_ROWS}) x""", extra_ctes=ROWS_CTE.strip()),
)(_effects)


def _tops(spark, d):
    t = SC.top_drivers(SC.project(_rows(spark, d), SPEC), 3)
    return t.select(*KEYS, F.col("rank").cast("int").alias("rank"), "driver",
                    F.round("pct_effect", 6).alias("pct_effect"))


register(
    "scenario_top_drivers", "F4",
    with_sales(f"""
SELECT scenario_id, region, fuel_type, segment, CAST(rank AS INT) AS rank, driver, ROUND(pct, 6) AS pct_effect
FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, region, fuel_type, segment
                                   ORDER BY abs(pct) DESC, pos ASC) AS rank
      FROM (SELECT *, (multiplier - 1.0) * 100.0 AS pct FROM ({_DRIVER_ROWS}) x) y
      WHERE abs(pct) > {SC.MATERIAL_EFFECT_PCT}) z
WHERE rank <= 3""", extra_ctes=ROWS_CTE.strip()),
)(_tops)


def _z(name: str) -> str:
    return hash_normal_sql(f"concat_ws(':', 'draw', '42', CAST(draw AS VARCHAR), '{name}')")


DRAWS_CTE = ROWS_CTE + f""",
dr AS (SELECT r.*, CAST(g.draw AS INT) AS draw FROM rows_ r
       CROSS JOIN (SELECT unnest(range(0, {N_DRAWS})) AS draw) g),
mc AS (
  SELECT scenario_id, region, fuel_type, segment, base_volume,
    base_volume
    * pow(1.0 + price_change_pct / 100.0, {_prior_sql(0)} + {_sd_sql(0)} * {_z('own_price')})
    * pow(1.0 + gdp_growth_pct / 100.0, {_prior_sql(1)} + {_sd_sql(1)} * {_z('income')})
    * pow(1.0 + fuel_price_change_pct / 100.0,
          CASE WHEN {ELEC} THEN {_prior_sql(3)} ELSE {_prior_sql(2)} END + {_sd_sql(2)} * {_z('fuel')})
    * pow(1.0 + fx_depreciation_pct / 100.0, {_prior_sql(0)} + {_sd_sql(0)} * {_z('own_price')})
    * greatest(1.0 + (CASE WHEN {ELEC} THEN 1.0 ELSE -1.0 END)
               * ({_prior_sql(4)} + {_sd_sql(3)} * {_z('regulation')}) * (regulation_change_pts / 10.0), 0.0)
      AS v
  FROM dr
)"""

_PCOLS = list(SC.PERCENTILES)


def _percentiles(spark, d):
    p = SC.draw_percentiles(SC.monte_carlo(_rows(spark, d), SPEC))
    return p.select(*KEYS, "base_volume", "n_draws", *[F.round(c, 4).alias(c) for c in _PCOLS],
                    F.round("ci80_low_pct", 4).alias("ci80_low_pct"), F.round("ci80_high_pct", 4).alias("ci80_high_pct"))


register(
    "scenario_draw_percentiles", "M4 M5 L5",
    with_sales(
        "SELECT scenario_id, region, fuel_type, segment, max(base_volume) AS base_volume, COUNT(*) AS n_draws, "
        + ", ".join(f"ROUND(quantile_cont(v, {q}), 4) AS {n}" for n, q in SC.PERCENTILES.items())
        + ", ROUND(CASE WHEN max(base_volume) = 0 THEN 0.0 ELSE (quantile_cont(v, 0.1) / max(base_volume) - 1.0) * 100.0"
          " END, 4) AS ci80_low_pct"
        + ", ROUND(CASE WHEN max(base_volume) = 0 THEN 0.0 ELSE (quantile_cont(v, 0.9) / max(base_volume) - 1.0) * 100.0"
          " END, 4) AS ci80_high_pct FROM mc GROUP BY scenario_id, region, fuel_type, segment",
        extra_ctes=DRAWS_CTE.strip()),
)(_percentiles)


def _narrative(spark, d):
    rows = _rows(spark, d)
    proj = SC.project(rows, SPEC)
    intervals = SC.draw_percentiles(SC.monte_carlo(rows, SPEC))
    return SC.narrative(proj, intervals)


register("scenario_narrative", "M6 H6 F4")(_narrative)
