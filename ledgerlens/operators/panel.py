"""External region×year(×fuel) panel and enrichment.

The panel is generated by Spark from the fact table's own (region, year) and
(region, fuel, year) keys, with deterministic hash noise, so it is exactly as
large as the key space of the facts and never a driver-side loop per region.
Joining it onto the facts is a broadcast hash join only after its size has been
checked; beyond the bound it becomes a shuffle join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.hashrand import hash_normal
from ledgerlens.operators.features import clip, value_map
from ledgerlens.session import write_shared
from ledgerlens.spec import PROVENANCE_ORDER, RESOLUTION_ORDER, TableSpec

# ---------------------------------------------------------------------------
# FIXED VALUES — panel parameters per reference region (must equal the
# reference application's mock generators).
# Region -> (World Bank aggregate code, currency, representative label, ISO3).
REGION_REFS = {
    "Asia": ("EAS", "CNY", "East Asia & Pacific", "CHN"),
    "North America": ("NAC", "USD", "North America", "USA"),
    "Middle East": ("MEA", "AED", "Middle East & N. Africa", "SAU"),
    "South America": ("LCN", "BRL", "Latin America & Carib.", "BRA"),
    "Europe": ("EMU", "EUR", "Euro area", "DEU"),
    "Africa": ("SSF", "ZAR", "Sub-Saharan Africa", "ZAF"),
}
# Macro mock: GDP per capita base (USD), inflation base (%); defaults 15000 / 3.0.
GDP_BASE = {"Asia": 11000, "North America": 62000, "Middle East": 22000,
            "South America": 9000, "Europe": 38000, "Africa": 1700}
INFLATION_BASE = {"Asia": 2.6, "North America": 2.3, "Middle East": 3.5,
                  "South America": 6.0, "Europe": 1.9, "Africa": 7.5}
GDP_DEFAULT, INFLATION_DEFAULT = 15000.0, 3.0
GDP_GROWTH_MEAN, GDP_GROWTH_SD, INFLATION_SD = 0.022, 0.01, 0.8
# CO2: emissions per capita ~2015 (t), stringency index in 2010 and yearly tightening.
EMISSIONS_BASE = {"North America": 15.0, "Middle East": 12.0, "Europe": 6.5,
                  "Asia": 5.0, "South America": 2.5, "Africa": 0.9}
STRINGENCY_2010 = {"Europe": 55, "North America": 42, "Asia": 35,
                   "South America": 22, "Africa": 15, "Middle East": 12}
ANNUAL_TIGHTENING = {"Europe": 2.6, "North America": 1.9, "Asia": 2.3,
                     "South America": 1.2, "Africa": 0.9, "Middle East": 1.0}
EMISSIONS_DEFAULT, STRINGENCY_DEFAULT, TIGHTENING_DEFAULT = 4.0, 25.0, 1.5
CO2_TARGET_2010, CO2_TARGET_SLOPE, CO2_TARGET_FLOOR = 160.0, 0.6, 45.0
STRINGENCY_NOISE_SD, EMISSIONS_DECLINE, EMISSIONS_NOISE_SD, EMISSIONS_FLOOR = 0.5, 0.008, 0.03, 0.05
# Fuel: petrol-equivalent USD/litre ~2017, drift 1.5%/yr, shocks sd 6%, multipliers.
FUEL_BASELINE = {"Europe": 1.55, "Asia": 1.05, "North America": 0.78,
                 "Middle East": 0.45, "South America": 1.00, "Africa": 0.95}
FUEL_MULTIPLIER = {"Petrol": 1.00, "Diesel": 0.92, "Hybrid": 0.55, "Electric": 0.30}
FUEL_DEFAULT, FUEL_DRIFT, FUEL_SHOCK_SD, FUEL_FLOOR = 1.0, 0.015, 0.06, 0.05
# FX: USD value of one unit (recent anchor) and yearly drift, noise sd 2%.
FX_ANCHOR = {"USD": 1.00, "EUR": 1.08, "CNY": 0.14, "AED": 0.272, "BRL": 0.18, "ZAR": 0.054}
FX_DRIFT = {"USD": 0.0, "EUR": -0.005, "CNY": -0.010, "AED": 0.0, "BRL": -0.030, "ZAR": -0.035}
FX_ANCHOR_DEFAULT, FX_DRIFT_DEFAULT, FX_NOISE_SD, FX_ANCHOR_YEAR = 0.5, -0.01, 0.02, 2024
# Scenario defaults when a series is absent; rounding 2 / 2 / 1 / 3.
DEFAULT_INFLATION, DEFAULT_GDP_GROWTH, DEFAULT_STRINGENCY, DEFAULT_FUEL_PRICE = 3.0, 2.0, 50.0, 1.0
# ---------------------------------------------------------------------------

PANEL_SOURCES = ("worldbank", "fuel_prices", "co2_regulations", "fx_rates")
# Panels are bounded by the fact key space (regions × years × fuels); broadcast
# them only below this many rows.
PANEL_BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class PanelWindow:
    start_year: int
    end_year: int


def year_window(facts: DataFrame, spec: TableSpec) -> PanelWindow:
    lo, hi = facts.agg(F.min(spec.year), F.max(spec.year)).first()
    return PanelWindow(int(lo), int(hi))


def _param(col: Column, table: dict, default) -> Column:
    return value_map(col, table, default)


# -- L1 spine -----------------------------------------------------------------
def spine(keys: DataFrame, window: PanelWindow, year: str = "year") -> DataFrame:
    """L1: each distinct key row × every year of the window (explode, no cross join)."""
    return keys.distinct().withColumn(year, F.explode(F.sequence(F.lit(window.start_year), F.lit(window.end_year))))


def region_spine(facts: DataFrame, spec: TableSpec, window: PanelWindow) -> DataFrame:
    keys = facts.select(F.col(spec.region).alias("region"))
    return _with_panel_region(spine(keys, window), spec)


def _with_panel_region(df: DataFrame, spec: TableSpec) -> DataFrame:
    alias = value_map(F.col("region"), spec.region_alias, None) if spec.region_alias else F.lit(None)
    return df.withColumn("panel_region", F.coalesce(alias, F.col("region")))


def _noise(source: str, window: PanelWindow, stream: str) -> Column:
    """N(0,1) keyed by (source, region, start, end, year, stream)."""
    return hash_normal(F.lit(source), F.col("panel_region"), F.lit(window.start_year),
                       F.lit(window.end_year), F.col("year"), F.lit(stream))


# Panel values are rounded half-even (``bround``), as NumPy rounds them.


# -- L6 macro -----------------------------------------------------------------
def macro_panel(sp: DataFrame, window: PanelWindow) -> DataFrame:
    """L6 + C1 + E4: GDP per capita (running-sum growth path) and inflation.

    The two indicators are built as separate series and full-outer joined on
    (region, year), as indicator payloads arrive one series at a time.
    """
    pr = F.col("panel_region")
    step = F.lit(GDP_GROWTH_MEAN) + F.lit(GDP_GROWTH_SD) * _noise("worldbank", window, "gdp")
    w = Window.partitionBy("region").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gdp = (
        sp.withColumn("_step", step)
        .withColumn("_growth", F.lit(1.0) + F.sum("_step").over(w) / F.lit(10.0))
        .select("region", "year", F.bround(_param(pr, GDP_BASE, GDP_DEFAULT) * F.col("_growth"), 0)
                .alias("gdp_per_capita_usd"))
    )
    inflation = sp.select(
        "region", "year",
        F.bround(_param(pr, INFLATION_BASE, INFLATION_DEFAULT)
                + F.lit(INFLATION_SD) * _noise("worldbank", window, "inflation"), 2).alias("inflation_pct"),
    )
    return inflation.join(gdp, ["region", "year"], "full_outer")


# -- L2 CO2 -------------------------------------------------------------------
def co2_panel(sp: DataFrame, window: PanelWindow) -> DataFrame:
    """L2: stringency schedule (+ noise), fleet CO2 target, emissions per capita."""
    pr, yr = F.col("panel_region"), F.col("year")
    base = _param(pr, STRINGENCY_2010, STRINGENCY_DEFAULT)
    slope = _param(pr, ANNUAL_TIGHTENING, TIGHTENING_DEFAULT)
    curated = clip(base + slope * (yr - F.lit(2010)), 0.0, 100.0)
    noisy = clip(curated + F.lit(STRINGENCY_NOISE_SD) * _noise("co2_regulations", window, "stringency"), 0.0, 100.0)
    target = F.greatest(F.lit(CO2_TARGET_2010) - F.lit(CO2_TARGET_SLOPE) * (curated - base), F.lit(CO2_TARGET_FLOOR))
    emissions = (
        _param(pr, EMISSIONS_BASE, EMISSIONS_DEFAULT)
        * (F.lit(1.0) - F.lit(EMISSIONS_DECLINE) * (yr - F.lit(2015)))
        * (F.lit(1.0) + F.lit(EMISSIONS_NOISE_SD) * _noise("co2_regulations", window, "emissions"))
    )
    return sp.select(
        "region", "year",
        F.bround(noisy, 1).alias("regulation_stringency_index"),
        F.bround(target, 1).alias("fleet_co2_target_g_km"),
        F.bround(F.greatest(emissions, F.lit(EMISSIONS_FLOOR)), 3).alias("co2_emissions_pc"),
    )


# -- L4 FX ----------------------------------------------------------------------
def fx_panel(sp: DataFrame, window: PanelWindow) -> DataFrame:
    """L4: USD per unit of the region's currency; the USD region is exactly 1.0."""
    pr, yr = F.col("panel_region"), F.col("year")
    currency = value_map(pr, {k: v[1] for k, v in REGION_REFS.items()}, None)
    anchor = value_map(currency, FX_ANCHOR, FX_ANCHOR_DEFAULT)
    drift = value_map(currency, FX_DRIFT, FX_DRIFT_DEFAULT)
    rate = anchor * F.pow(F.lit(1.0) + drift, (yr - F.lit(FX_ANCHOR_YEAR)).cast("double")) * (
        F.lit(1.0) + F.lit(FX_NOISE_SD) * _noise("fx_rates", window, "fx")
    )
    return sp.select(
        "region", "year", currency.alias("currency"),
        F.when(currency == "USD", F.lit(1.0)).otherwise(F.bround(rate, 5)).alias("usd_per_unit"),
    )


# -- L3 / C7 fuel -----------------------------------------------------------------
def fuel_panel(facts: DataFrame, spec: TableSpec, window: PanelWindow) -> DataFrame:
    """L3 + C7: petrol series per region × fuel multipliers, floored and rounded.

    The (region, fuel) pairs come from the facts; each pair is expanded over the
    years, so no region × fuel cross product is materialised.
    """
    keys = facts.select(F.col(spec.region).alias("region"), F.col(spec.fuel).alias("fuel_type"))
    sp = _with_panel_region(spine(keys, window), spec)
    pr, yr = F.col("panel_region"), F.col("year")
    petrol = (
        _param(pr, FUEL_BASELINE, FUEL_DEFAULT)
        * (F.lit(1.0) + F.lit(FUEL_DRIFT) * (yr - F.lit(2017)))
        * (F.lit(1.0) + F.lit(FUEL_SHOCK_SD) * _noise("fuel_prices", window, "petrol"))
    )
    family = value_map(F.col("fuel_type"), spec.fuel_family, "Petrol") if spec.fuel_family else F.col("fuel_type")
    mult = value_map(family, FUEL_MULTIPLIER, 1.0)
    return sp.select(
        "region", "year", "fuel_type",
        F.bround(F.greatest(petrol * mult, F.lit(FUEL_FLOOR)), 3).alias("price_usd_per_litre"),
    )


# -- L7 / C2 assemble ---------------------------------------------------------------
def build_external_panel(facts: DataFrame, spec: TableSpec, window: PanelWindow | None = None):
    """(region×year panel, region×year×fuel panel, provenance frame).

    macro ⟗ CO2 ⟗ FX on (region, year) (C2). The facts are read once, for their
    distinct (region, fuel, year); the key table and both panels are written, so
    whatever uses them scans small tables.
    """
    keys = write_shared(facts.select(spec.region, spec.fuel, spec.year).distinct(), "panel-keys")
    window = window or year_window(keys, spec)
    sp = region_spine(keys, spec, window)
    panel = write_shared(
        macro_panel(sp, window)
        .join(co2_panel(sp, window), ["region", "year"], "full_outer")
        .join(fx_panel(sp, window), ["region", "year"], "full_outer"), "panel")
    fuel = write_shared(fuel_panel(keys, spec, window), "fuel-panel")
    spark = facts.sparkSession
    provenance = spark.createDataFrame([(s, "mock") for s in PANEL_SOURCES], "source string, provenance string")
    return panel, fuel, provenance


# -- C3–C5 enrichment ---------------------------------------------------------------
def _checked_dimension(dim: DataFrame, keys: list[str], max_rows: int) -> DataFrame:
    """Raise if ``keys`` repeat in ``dim``; broadcast it only if under ``max_rows``.

    One aggregate job gives both the row count and the largest key multiplicity.
    """
    stats = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum("c").alias("n"), F.max("c").alias("m")
    ).first()
    n, m = int(stats["n"] or 0), int(stats["m"] or 0)
    if m > 1:
        raise ValueError(f"panel keys {keys} are not unique (max multiplicity {m})")
    return F.broadcast(dim) if n <= max_rows else dim


def enrich(facts: DataFrame, spec: TableSpec, panel: DataFrame, fuel: DataFrame,
           max_broadcast_rows: int = PANEL_BROADCAST_ROWS) -> DataFrame:
    """Facts ⟕ panel on (region, year) ⟕ fuel panel on (region, year, fuel).

    Left joins on unique keys: the row count of the facts cannot change.
    """
    p = _checked_dimension(panel, ["region", "year"], max_broadcast_rows)
    f = _checked_dimension(fuel, ["region", "year", "fuel_type"], max_broadcast_rows)
    p = p.withColumnRenamed("region", "_region").withColumnRenamed("year", "_year")
    f = (f.withColumnRenamed("region", "_fregion").withColumnRenamed("year", "_fyear")
         .withColumnRenamed("fuel_type", "_ffuel"))
    out = facts.join(
        p, (F.col(spec.region).cast("string") == F.col("_region")) & (F.col(spec.year).cast("int") == F.col("_year")),
        "left",
    ).join(
        f, (F.col(spec.region).cast("string") == F.col("_fregion")) & (F.col(spec.year).cast("int") == F.col("_fyear"))
        & (F.col(spec.fuel).cast("string") == F.col("_ffuel")),
        "left",
    )
    return out.drop("_region", "_year", "_fregion", "_fyear", "_ffuel")


def coverage_gaps(facts: DataFrame, spec: TableSpec, panel: DataFrame) -> DataFrame:
    """C5 report: fact (region, year) keys with no panel row (left anti join)."""
    keys = facts.select(F.col(spec.region).alias("region"), F.col(spec.year).cast("int").alias("year")).distinct()
    return keys.join(panel.select("region", "year"), ["region", "year"], "left_anti")


# -- C6 region reference ------------------------------------------------------------
def region_reference(df: DataFrame, region_col: str, spec: TableSpec) -> DataFrame:
    """Look up each distinct region's external references; unknown -> KeyError."""
    regions = _with_panel_region(df.select(F.col(region_col).alias("region")).distinct(), spec)
    spark = df.sparkSession
    refs = spark.createDataFrame(
        [(k, *v) for k, v in REGION_REFS.items()],
        "panel_region string, worldbank_code string, currency string, representative string, country_iso3 string",
    )
    missing = regions.join(F.broadcast(refs), "panel_region", "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"unknown regions: {[r.region for r in missing]}")
    return regions.join(F.broadcast(refs), "panel_region").drop("panel_region")


# -- E3 gap fill --------------------------------------------------------------------
def gap_fill(obs: DataFrame, keys: list[str], value_cols: list[str], window: PanelWindow,
             year: str = "year") -> DataFrame:
    """Reindex each key to every year, forward- then backward-fill.

    Windows are partitioned by the key, so each series is one task; series are
    bounded by the number of years.
    """
    full = spine(obs.select(*keys), window, year).join(obs, [*keys, year], "left")
    fwd = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bwd = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return full.select(*keys, year, *[
        F.coalesce(F.last(c, ignorenulls=True).over(fwd), F.first(c, ignorenulls=True).over(bwd)).alias(c)
        for c in value_cols
    ])


# -- E5 scenario defaults -----------------------------------------------------------
def macro_defaults(panel: DataFrame, fuel: DataFrame, as_of_year: int, lookback: int = 2) -> DataFrame:
    """E5 + D18: per region, latest inflation, compound GDP growth, stringency, mean fuel price.

    Inflation and GDP look back ``lookback`` years; absent series fall back to
    fixed defaults. One grouped aggregate per input, joined on region.
    """
    recent = panel.where(F.col("year").between(as_of_year - lookback, as_of_year))
    gdp_ok = F.col("gdp_per_capita_usd").isNotNull()
    macro = recent.groupBy("region").agg(
        F.max_by(F.when(F.col("inflation_pct").isNotNull(), F.col("inflation_pct")),
                 F.when(F.col("inflation_pct").isNotNull(), F.col("year"))).alias("_infl"),
        F.max_by(F.when(gdp_ok, F.col("gdp_per_capita_usd")), F.when(gdp_ok, F.col("year"))).alias("_g_last"),
        F.min_by(F.when(gdp_ok, F.col("gdp_per_capita_usd")), F.when(gdp_ok, F.col("year"))).alias("_g_first"),
        F.count(F.when(gdp_ok, 1)).alias("_g_n"),
        F.max(F.when(F.col("year") == as_of_year, F.col("regulation_stringency_index"))).alias("_str"),
    )
    growth = F.when(
        F.col("_g_n") >= 2,
        (F.pow(F.col("_g_last") / F.col("_g_first"),
               F.lit(1.0) / F.greatest(F.col("_g_n") - 1, F.lit(1)).cast("double")) - 1.0) * 100.0,
    ).otherwise(F.lit(DEFAULT_GDP_GROWTH))
    fuel_now = fuel.where(F.col("year") == as_of_year).groupBy("region").agg(
        F.avg("price_usd_per_litre").alias("_fuel")
    )
    return macro.join(fuel_now, "region", "full_outer").select(
        "region",
        F.bround(F.coalesce(F.col("_infl"), F.lit(DEFAULT_INFLATION)), 2).alias("inflation_pct"),
        F.bround(growth, 2).alias("gdp_growth_pct"),
        F.bround(F.coalesce(F.col("_str"), F.lit(DEFAULT_STRINGENCY)), 1).alias("regulation_stringency"),
        F.bround(F.coalesce(F.col("_fuel"), F.lit(DEFAULT_FUEL_PRICE)), 3).alias("fuel_price_usd_per_litre"),
    )


# -- A9–A11 provenance ---------------------------------------------------------------
def provenance_rank(tag: Column) -> Column:
    """Strength rank of a provenance tag: live 0, cache 1, mock 2."""
    return value_map(tag, {t: i for i, t in enumerate(PROVENANCE_ORDER)}, len(PROVENANCE_ORDER))


def resolve_precedence(landed: DataFrame, keys: list[str], tag: str = "provenance") -> DataFrame:
    """Per key keep the row of the first source that has it (cache, live, mock).

    ``min_by`` on the rank in a grouped aggregate: partial aggregation keeps one
    candidate per key per task, so no window sort over the landed rows.
    """
    others = [c for c in landed.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    rank = value_map(F.col(tag), {t: i for i, t in enumerate(RESOLUTION_ORDER)}, len(RESOLUTION_ORDER))
    best = landed.groupBy(*keys).agg(F.min_by(packed, rank).alias("_best"))
    return best.select(*keys, "_best.*")


def weakest_provenance(prov: DataFrame) -> DataFrame:
    """A10: per source, the weakest tag actually used (mock > cache > live)."""
    return prov.groupBy("source").agg(F.max_by("provenance", provenance_rank(F.col("provenance"))).alias("provenance"))


def provenance_summary(prov: DataFrame) -> DataFrame:
    """One row per tag with its sources, comma-joined in name order."""
    return prov.groupBy("provenance").agg(
        F.concat_ws(", ", F.array_sort(F.collect_set("source"))).alias("sources")
    )
