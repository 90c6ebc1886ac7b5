"""Queries: engineered features, positive-target log, label encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.plans.catalogue import facts, register
from ledgerlens.plans.oracle import SPEC, with_sales

_ROUNDED = ["mileage_per_year", "price_per_litre_engine", "log_price", "log_mileage"]


def _features(spark, d):
    f = FE.add_engineered_features(facts(spark, d), SPEC)
    return f.select(
        "row_key", "vehicle_age",
        *[F.round(c, 6).alias(c) for c in _ROUNDED],
        "is_electrified", "is_premium_tier",
    )


register(
    "engineered_features", "B4 B5 B6 B7 B8 B9 H4",
    with_sales(
        "SELECT row_key, vehicle_age, "
        + ", ".join(f"ROUND({c}, 6) AS {c}" for c in _ROUNDED)
        + ", is_electrified, is_premium_tier FROM feat",
        features=True,
    ),
)(_features)

register(
    "log_volume_positive", "B3",
    with_sales("SELECT row_key, ROUND(ln(CAST(Sales_Volume AS DOUBLE)), 9) AS log_volume FROM sales WHERE Sales_Volume > 0"),
)(lambda spark, d: FE.positive_log_target(facts(spark, d), SPEC).select(
    "row_key", F.round("log_volume", 9).alias("log_volume")))

register(
    "label_encoded", "B12 B13",
    with_sales("""
SELECT row_key, Model, Year, Region, Color, Fuel_Type, Transmission, Engine_Size_L, Mileage_KM, Price_USD,
       Sales_Volume, CASE WHEN Sales_Classification = 'High' THEN 1 ELSE 0 END AS label
FROM sales"""),
)(lambda spark, d: FE.drop_leaked(FE.label_encode(facts(spark, d), SPEC), SPEC))


def _clipped_effect(spark, d):
    f = facts(spark, d)
    effect = FE.value_map(F.col(SPEC.region), SPEC.region_effect, 0.0)
    return f.select(
        "row_key",
        effect.alias("region_effect"),
        FE.clip(F.col(SPEC.volume).cast("double") * 200.0 + effect, 100.0, 9000.0).alias("clipped"),
    )


_EFFECT_CASE = "CASE Region " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in SPEC.region_effect.items()
) + " ELSE 0.0 END"
register(
    "region_effect_clipped", "B14 B15",
    with_sales(f"""
SELECT row_key, CAST({_EFFECT_CASE} AS DOUBLE) AS region_effect,
       least(greatest(CAST(Sales_Volume AS DOUBLE) * 200.0 + {_EFFECT_CASE}, 100.0), 9000.0) AS clipped
FROM sales"""),
)(_clipped_effect)
