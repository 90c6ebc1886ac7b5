"""Column roles, thresholds and fixed parameter values.

A :class:`TableSpec` names the columns of a fact table and the roles the
operators need (targets, label values, flag sets). Operators never hard-code a
column name; they read it from the spec they are given.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference application's for matching results.
# Canonical fact columns, in the reference's order.
FACT_COLUMNS = (
    "Model", "Year", "Region", "Color", "Fuel_Type", "Transmission",
    "Engine_Size_L", "Mileage_KM", "Price_USD", "Sales_Volume", "Sales_Classification",
)
# Canonical Spark DDL of the fact table.
FACT_DDL = (
    "Model STRING, Year SMALLINT, Region STRING, Color STRING, Fuel_Type STRING, "
    "Transmission STRING, Engine_Size_L FLOAT, Mileage_KM INT, Price_USD INT, "
    "Sales_Volume INT, Sales_Classification STRING"
)
CATEGORICAL = ("Model", "Region", "Color", "Fuel_Type", "Transmission")
NUMERIC = ("Year", "Engine_Size_L", "Mileage_KM", "Price_USD", "Sales_Volume")
# Premium models, electrified fuels, reference year, leakage threshold.
REFERENCE_PREMIUM_MODELS = ("7 Series", "M5", "M3", "i8", "X6", "X5")
REFERENCE_ELECTRIFIED_FUELS = ("Hybrid", "Electric")
REFERENCE_YEAR = 2024
REFERENCE_LEAK_THRESHOLD = 7000
# Region demand offsets of the signal-bearing synthetic target.
REFERENCE_REGION_EFFECT = {
    "Europe": 1500.0, "North America": 1200.0, "Asia": 900.0,
    "Middle East": 300.0, "South America": 0.0, "Africa": -400.0,
}
# Synthetic target: base 5000, +600 premium, +350 per litre, +40 per year since
# 2010, -0.02 per USD of price, +500 electrified, N(0, 400) noise, floor 100.
SYNTH_BASE = 5000.0
SYNTH_PREMIUM = 600.0
SYNTH_ENGINE = 350.0
SYNTH_YEAR = 40.0
SYNTH_YEAR0 = 2010
SYNTH_PRICE = -0.02
SYNTH_ELECTRIFIED = 500.0
SYNTH_NOISE_SD = 400.0
SYNTH_FLOOR = 100.0
# Engineered feature names.
ENGINEERED_NUMERIC = (
    "vehicle_age", "mileage_per_year", "price_per_litre_engine", "log_price", "log_mileage",
)
ENGINEERED_CATEGORICAL = ("is_electrified", "is_premium_tier")
# External (enriched) numeric columns used as features when present.
ENRICHED_NUMERIC = (
    "inflation_pct", "gdp_per_capita_usd", "regulation_stringency_index",
    "fleet_co2_target_g_km", "co2_emissions_pc", "price_usd_per_litre", "usd_per_unit",
)
# Verdict thresholds.
CORR_NO_SIGNAL = 0.05
MI_NO_SIGNAL = 0.01
SIGNIFICANCE = 0.05
R2_SIGNAL = 0.05
CAUSAL_MIN_EFFECT = 0.05
CONTROL_R2 = 0.5
CONFORMAL_INFORMATIVE = 0.6
# Provenance tags, strongest first (a weaker tag wins when reporting a source).
PROVENANCE_ORDER = ("live", "cache", "mock")
# Where a value is taken from when several sources have it, first choice first.
RESOLUTION_ORDER = ("cache", "live", "mock")
# Default random seed.
SEED = 42
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TableSpec:
    """Names and roles of the fact-table columns."""

    model: str = "Model"
    year: str = "Year"
    region: str = "Region"
    color: str = "Color"
    fuel: str = "Fuel_Type"
    transmission: str = "Transmission"
    engine: str = "Engine_Size_L"
    mileage: str = "Mileage_KM"
    price: str = "Price_USD"
    volume: str = "Sales_Volume"
    label: str = "Sales_Classification"
    key: str = "row_key"
    positive_label: str = "High"
    negative_label: str = "Low"
    premium_models: tuple[str, ...] = REFERENCE_PREMIUM_MODELS
    electrified_fuels: tuple[str, ...] = REFERENCE_ELECTRIFIED_FUELS
    reference_year: int = REFERENCE_YEAR
    leak_threshold: int = REFERENCE_LEAK_THRESHOLD
    region_effect: dict[str, float] = field(default_factory=lambda: dict(REFERENCE_REGION_EFFECT))
    # Region name -> the name used by the external-panel parameters.
    region_alias: dict[str, str] = field(default_factory=dict)
    # Fuel value -> fuel-price multiplier family (Petrol/Diesel/Hybrid/Electric).
    fuel_family: dict[str, str] = field(default_factory=dict)

    @property
    def categorical(self) -> tuple[str, ...]:
        return (self.model, self.region, self.color, self.fuel, self.transmission)

    @property
    def numeric(self) -> tuple[str, ...]:
        return (self.year, self.engine, self.mileage, self.price, self.volume)

    @property
    def fact_columns(self) -> tuple[str, ...]:
        return (
            self.model, self.year, self.region, self.color, self.fuel, self.transmission,
            self.engine, self.mileage, self.price, self.volume, self.label,
        )

    def panel_region(self, region: str) -> str:
        return self.region_alias.get(region, region)


REFERENCE_SPEC = TableSpec(
    fuel_family={"Petrol": "Petrol", "Diesel": "Diesel", "Hybrid": "Hybrid", "Electric": "Electric"},
)

# Roles for the facts projected from the TPC-H-like test tables (see
# ledgerlens.sources.facts): brands play models, market segments play fuels.
TPCH_SPEC = TableSpec(
    premium_models=("Brand#1", "Brand#7", "Brand#13", "Brand#19", "Brand#25"),
    electrified_fuels=("AUTOMOBILE", "MACHINERY"),
    reference_year=2001,
    leak_threshold=35,
    region_effect={
        "EUROPE": 1500.0, "AMERICA": 1200.0, "ASIA": 900.0, "MIDDLE EAST": 300.0, "AFRICA": -400.0,
    },
    region_alias={
        "AFRICA": "Africa", "AMERICA": "North America", "ASIA": "Asia",
        "EUROPE": "Europe", "MIDDLE EAST": "Middle East",
    },
    fuel_family={
        "AUTOMOBILE": "Electric", "MACHINERY": "Hybrid", "BUILDING": "Petrol",
        "FURNITURE": "Diesel", "HOUSEHOLD": "Petrol",
    },
)
