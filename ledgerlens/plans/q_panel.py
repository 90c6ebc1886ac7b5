"""Queries: external panel, enrichment, gap fill, scenario defaults, region refs
(L1–L7, C1–C7, E3–E5, D18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.operators import panel as PN
from ledgerlens.plans.catalogue import facts, register
from ledgerlens.plans.oracle import SPEC, case_map, dbl, hash_normal_sql, with_sales

PANEL_REGION_SQL = case_map("region", SPEC.region_alias, None).replace("ELSE NULL END)", "ELSE region END)")


def _noise_sql(source: str, stream: str) -> str:
    text = (f"concat_ws(':', '{source}', panel_region, CAST(lo AS VARCHAR), CAST(hi AS VARCHAR), "
            f"CAST(year AS VARCHAR), '{stream}')")
    return hash_normal_sql(text)


def _clip_sql(x: str, lo, hi) -> str:
    return f"least(greatest({x}, {dbl(lo)}), {dbl(hi)})"


CURRENCY_SQL = case_map("panel_region", {k: v[1] for k, v in PN.REGION_REFS.items()}, None)
STR_BASE = case_map("panel_region", PN.STRINGENCY_2010, PN.STRINGENCY_DEFAULT)
STR_SLOPE = case_map("panel_region", PN.ANNUAL_TIGHTENING, PN.TIGHTENING_DEFAULT)
CURATED = _clip_sql(f"{STR_BASE} + {STR_SLOPE} * (year - 2010)", 0, 100)

PANEL_CTES = f"""
w AS (SELECT min(Year) AS lo, max(Year) AS hi FROM sales),
sp AS (
  SELECT region, {PANEL_REGION_SQL} AS panel_region, CAST(g.year AS INT) AS year, lo, hi
  FROM (SELECT DISTINCT Region AS region FROM sales) r
  CROSS JOIN (SELECT unnest(generate_series(lo, hi)) AS year, lo, hi FROM w) g
),
mac AS (
  SELECT region, year,
    round_even({case_map('panel_region', PN.INFLATION_BASE, PN.INFLATION_DEFAULT)}
          + {dbl(PN.INFLATION_SD)} * {_noise_sql('worldbank', 'inflation')}, 2) AS inflation_pct,
    round_even({case_map('panel_region', PN.GDP_BASE, PN.GDP_DEFAULT)}
          * ({dbl(1)} + SUM({dbl(PN.GDP_GROWTH_MEAN)} + {dbl(PN.GDP_GROWTH_SD)} * {_noise_sql('worldbank', 'gdp')})
             OVER (PARTITION BY region ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / {dbl(10)}),
          0) AS gdp_per_capita_usd
  FROM sp
),
co2 AS (
  SELECT region, year,
    round_even({_clip_sql(f"{CURATED} + {dbl(PN.STRINGENCY_NOISE_SD)} * {_noise_sql('co2_regulations', 'stringency')}", 0, 100)}, 1)
      AS regulation_stringency_index,
    round_even(greatest({dbl(PN.CO2_TARGET_2010)} - {dbl(PN.CO2_TARGET_SLOPE)} * ({CURATED} - {STR_BASE}),
                   {dbl(PN.CO2_TARGET_FLOOR)}), 1) AS fleet_co2_target_g_km,
    round_even(greatest({case_map('panel_region', PN.EMISSIONS_BASE, PN.EMISSIONS_DEFAULT)}
                   * ({dbl(1)} - {dbl(PN.EMISSIONS_DECLINE)} * (year - 2015))
                   * ({dbl(1)} + {dbl(PN.EMISSIONS_NOISE_SD)} * {_noise_sql('co2_regulations', 'emissions')}),
                   {dbl(PN.EMISSIONS_FLOOR)}), 3) AS co2_emissions_pc
  FROM sp
),
fx AS (
  SELECT region, year, currency,
    CASE WHEN currency = 'USD' THEN {dbl(1)} ELSE round_even(
      {case_map('currency', PN.FX_ANCHOR, PN.FX_ANCHOR_DEFAULT)}
      * pow({dbl(1)} + {case_map('currency', PN.FX_DRIFT, PN.FX_DRIFT_DEFAULT)}, CAST(year - {PN.FX_ANCHOR_YEAR} AS DOUBLE))
      * ({dbl(1)} + {dbl(PN.FX_NOISE_SD)} * {_noise_sql('fx_rates', 'fx')}), 5) END AS usd_per_unit
  FROM (SELECT *, {CURRENCY_SQL} AS currency FROM sp) s
),
panel AS (
  SELECT mac.region, mac.year, inflation_pct, gdp_per_capita_usd, regulation_stringency_index,
         fleet_co2_target_g_km, co2_emissions_pc, currency, usd_per_unit
  FROM mac JOIN co2 USING (region, year) JOIN fx USING (region, year)
),
fsp AS (
  SELECT k.region, {PANEL_REGION_SQL.replace('region', 'k.region')} AS panel_region, k.fuel_type,
         CAST(g.year AS INT) AS year, lo, hi
  FROM (SELECT DISTINCT Region AS region, Fuel_Type AS fuel_type FROM sales) k
  CROSS JOIN (SELECT unnest(generate_series(lo, hi)) AS year, lo, hi FROM w) g
),
fuel AS (
  SELECT region, year, fuel_type,
    round_even(greatest({case_map('panel_region', PN.FUEL_BASELINE, PN.FUEL_DEFAULT)}
                   * ({dbl(1)} + {dbl(PN.FUEL_DRIFT)} * (year - 2017))
                   * ({dbl(1)} + {dbl(PN.FUEL_SHOCK_SD)} * {_noise_sql('fuel_prices', 'petrol')})
                   * {case_map(case_map('fuel_type', SPEC.fuel_family, 'Petrol'), PN.FUEL_MULTIPLIER, 1.0)},
                   {dbl(PN.FUEL_FLOOR)}), 3) AS price_usd_per_litre
  FROM fsp
)"""


def panel_sql(body: str) -> str:
    return with_sales(body, extra_ctes=PANEL_CTES.strip())


PANEL_COLS = ["inflation_pct", "gdp_per_capita_usd", "regulation_stringency_index", "fleet_co2_target_g_km",
              "co2_emissions_pc", "currency", "usd_per_unit"]


def _panels(spark, d):
    f = facts(spark, d)
    return f, PN.build_external_panel(f, SPEC)


register("external_panel", "L1 L2 L4 L5 L6 L7 C1 C2 E4 G1",
         panel_sql("SELECT region, year, " + ", ".join(PANEL_COLS) + " FROM panel"))(
    lambda spark, d: _panels(spark, d)[1][0].select("region", "year", *PANEL_COLS)
)

register("fuel_price_panel", "L3 C7", panel_sql("SELECT region, year, fuel_type, price_usd_per_litre FROM fuel"))(
    lambda spark, d: _panels(spark, d)[1][1]
)


def _enriched(spark, d):
    f, (panel, fuel, _) = _panels(spark, d)
    out = PN.enrich(f, SPEC, panel, fuel)
    return out.select("row_key", *PANEL_COLS, "price_usd_per_litre")


register(
    "enriched_facts", "C3 C4 C5",
    panel_sql("""
SELECT s.row_key, p.inflation_pct, p.gdp_per_capita_usd, p.regulation_stringency_index, p.fleet_co2_target_g_km,
       p.co2_emissions_pc, p.currency, p.usd_per_unit, fu.price_usd_per_litre
FROM sales s
LEFT JOIN panel p ON p.region = s.Region AND p.year = s.Year
LEFT JOIN fuel fu ON fu.region = s.Region AND fu.year = s.Year AND fu.fuel_type = s.Fuel_Type"""),
)(_enriched)


def _coverage(spark, d):
    """A panel that has lost every third year: its gaps are those years' keys."""
    f, (panel, _, _) = _panels(spark, d)
    return PN.coverage_gaps(f, SPEC, panel.where(F.col("year") % 3 != 0))


register("panel_coverage_gaps", "C5",
         panel_sql("SELECT DISTINCT s.Region AS region, s.Year AS year FROM sales s "
                   "WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.region = s.Region AND p.year = s.Year AND p.year % 3 <> 0)"))(_coverage)


def _feature_presence(spark, d):
    f, (panel, fuel, _) = _panels(spark, d)
    enriched = FE.add_engineered_features(PN.enrich(f, SPEC, panel, fuel), SPEC)
    return FE.feature_presence(enriched, SPEC).drop("position")


_PRESENCE_NUM = ["Year", "Engine_Size_L", "Mileage_KM", "Price_USD", "vehicle_age", "mileage_per_year",
                 "price_per_litre_engine", "log_price", "log_mileage", "inflation_pct", "gdp_per_capita_usd",
                 "regulation_stringency_index", "fleet_co2_target_g_km", "co2_emissions_pc",
                 "price_usd_per_litre", "usd_per_unit"]
_PRESENCE_CAT = ["Model", "Region", "Color", "Fuel_Type", "Transmission", "is_electrified", "is_premium_tier"]
register(
    "feature_presence", "B10",
    with_sales(
        " UNION ALL ".join(
            [f"SELECT 'numeric' AS role, '{c}' AS feature, COUNT({c}) AS n_nonnull FROM ef" for c in _PRESENCE_NUM]
            + [f"SELECT 'categorical', '{c}', COUNT({c}) FROM ef" for c in _PRESENCE_CAT]
        ),
        features=True,
        extra_ctes=PANEL_CTES.strip() + """,
ef AS (SELECT f.*, p.inflation_pct, p.gdp_per_capita_usd, p.regulation_stringency_index, p.fleet_co2_target_g_km,
              p.co2_emissions_pc, p.usd_per_unit, fu.price_usd_per_litre
       FROM feat f LEFT JOIN panel p ON p.region = f.Region AND p.year = f.Year
       LEFT JOIN fuel fu ON fu.region = f.Region AND fu.year = f.Year AND fu.fuel_type = f.Fuel_Type)""",
    ),
)(_feature_presence)


def _macro_defaults(spark, d):
    f, (panel, fuel, _) = _panels(spark, d)
    as_of = PN.year_window(f, SPEC).end_year
    return PN.macro_defaults(panel, fuel, as_of)


register(
    "macro_defaults", "E5 D18",
    panel_sql("""
SELECT m.region,
       round_even(coalesce(m.infl, 3.0), 2) AS inflation_pct,
       round_even(CASE WHEN m.g_n >= 2 THEN (pow(m.g_last / m.g_first, 1.0 / greatest(m.g_n - 1, 1)) - 1.0) * 100.0
                  ELSE 2.0 END, 2) AS gdp_growth_pct,
       round_even(coalesce(m.str, 50.0), 1) AS regulation_stringency,
       round_even(coalesce(fu.fp, 1.0), 3) AS fuel_price_usd_per_litre
FROM (
  SELECT region,
         arg_max(inflation_pct, year) FILTER (WHERE inflation_pct IS NOT NULL) AS infl,
         arg_max(gdp_per_capita_usd, year) FILTER (WHERE gdp_per_capita_usd IS NOT NULL) AS g_last,
         arg_min(gdp_per_capita_usd, year) FILTER (WHERE gdp_per_capita_usd IS NOT NULL) AS g_first,
         COUNT(gdp_per_capita_usd) AS g_n,
         max(CASE WHEN year = (SELECT hi FROM w) THEN regulation_stringency_index END) AS str
  FROM panel WHERE year BETWEEN (SELECT hi FROM w) - 2 AND (SELECT hi FROM w) GROUP BY region
) m
FULL OUTER JOIN (SELECT region, AVG(price_usd_per_litre) AS fp FROM fuel WHERE year = (SELECT hi FROM w)
                 GROUP BY region) fu ON fu.region = m.region"""),
)(_macro_defaults)

_REF_ROWS = " UNION ALL ".join(
    f"SELECT '{k}' AS panel_region, '{v[0]}' AS worldbank_code, '{v[1]}' AS currency, "
    f"'{v[2].replace(chr(39), chr(39) * 2)}' AS representative, '{v[3]}' AS country_iso3"
    for k, v in PN.REGION_REFS.items()
)
register(
    "region_reference_lookup", "C6",
    with_sales(f"""
SELECT r.region, ref.worldbank_code, ref.currency, ref.representative, ref.country_iso3
FROM (SELECT DISTINCT Region AS region, {PANEL_REGION_SQL.replace('region', 'Region')} AS panel_region FROM sales) r
JOIN ({_REF_ROWS}) ref ON ref.panel_region = r.panel_region"""),
)(lambda spark, d: PN.region_reference(facts(spark, d), SPEC.region, SPEC))


def _gap_filled(spark, d):
    f = facts(spark, d)
    window = PN.year_window(f, SPEC)
    obs = f.groupBy(F.col(SPEC.region).alias("region"), F.col(SPEC.transmission).alias("transmission"),
                    F.col(SPEC.year).alias("year")).agg(
        F.round(F.avg(F.col(SPEC.price).cast("double")), 6).alias("mean_price"))
    return PN.gap_fill(obs, ["region", "transmission"], ["mean_price"], window)


register(
    "gap_filled_price_by_status", "E3",
    with_sales("""
SELECT k.region, k.transmission, k.year,
       coalesce(last_value(o.mean_price IGNORE NULLS) OVER (PARTITION BY k.region, k.transmission ORDER BY k.year
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(o.mean_price IGNORE NULLS) OVER (PARTITION BY k.region, k.transmission ORDER BY k.year
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mean_price
FROM (SELECT DISTINCT Region AS region, Transmission AS transmission, CAST(g.year AS INT) AS year
      FROM sales CROSS JOIN (SELECT unnest(generate_series(min(Year), max(Year))) AS year FROM sales) g) k
LEFT JOIN (SELECT Region AS region, Transmission AS transmission, Year AS year,
                  ROUND(AVG(CAST(Price_USD AS DOUBLE)), 6) AS mean_price
           FROM sales GROUP BY Region, Transmission, Year) o
  ON o.region = k.region AND o.transmission = k.transmission AND o.year = k.year"""),
)(_gap_filled)
