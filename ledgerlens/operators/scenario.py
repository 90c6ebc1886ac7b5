"""What-if projections over tables of scenarios.

Baselines are Spark aggregates of the facts (volume per region × fuel ×
segment); a scenario list is a bounded parameter array exploded onto every
baseline row (no cross join). Monte-Carlo draws are hash-seeded normals keyed by
the draw index, spread over the cluster in chunks, and reduced by per-group
percentiles whose input is bounded by the number of draws.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.hashrand import hash_normal
from ledgerlens.operators.features import value_map
from ledgerlens.spec import TableSpec

# ---------------------------------------------------------------------------
# FIXED VALUES — elasticity priors per segment (deterministic means and the
# Monte-Carlo standard deviations), must equal the reference application's.
PRIORS = {
    #            own_price, income, fuel_combustion, fuel_electrified, regulation_per_10pts
    "standard": (-0.7, 1.3, -0.15, 0.10, 0.08),
    "premium": (-0.3, 2.2, -0.08, 0.06, 0.08),
}
PRIOR_SD = {
    #            own_price_sd, income_sd, fuel_sd, regulation_sd
    "standard": (0.2, 0.4, 0.08, 0.03),
    "premium": (0.15, 0.5, 0.08, 0.03),
}
DRIVERS = ("List price", "Income (GDP/cap)", "Fuel price", "CO2 regulation", "FX (currency)")
FLAT_BAND_PCT = 0.5
MATERIAL_EFFECT_PCT = 0.05
N_DRAWS = 5000
PERCENTILES = {"p2_5": 0.025, "p10": 0.10, "p50": 0.50, "p90": 0.90, "p97_5": 0.975}
# ---------------------------------------------------------------------------
DRAW_CHUNK = 500


@dataclass(frozen=True)
class Scenario:
    scenario_id: str
    price_change_pct: float = 0.0
    gdp_growth_pct: float = 0.0
    fuel_price_change_pct: float = 0.0
    regulation_change_pts: float = 0.0
    fx_depreciation_pct: float = 0.0


def baselines(facts: DataFrame, spec: TableSpec) -> DataFrame:
    """Base volume per region × fuel × segment (premium tier or standard)."""
    segment = F.when(F.col(spec.model).isin(list(spec.premium_models)), "premium").otherwise("standard")
    return facts.groupBy(
        F.col(spec.region).alias("region"), F.col(spec.fuel).alias("fuel_type"), segment.alias("segment")
    ).agg(F.sum(spec.volume).cast("double").alias("base_volume"))


def attach_scenarios(base: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Every baseline row × every scenario (a bounded literal array, exploded)."""
    arr = F.array(*[
        F.struct(*[F.lit(v).alias(k) if k == "scenario_id" else F.lit(float(v)).alias(k)
                   for k, v in asdict(s).items()]) for s in scenarios
    ])
    return base.withColumn("_s", F.explode(arr)).select("*", "_s.*").drop("_s")


def _prior(i: int, segment: Column) -> Column:
    return value_map(segment, {k: v[i] for k, v in PRIORS.items()}, PRIORS["standard"][i])


def _prior_sd(i: int, segment: Column) -> Column:
    return value_map(segment, {k: v[i] for k, v in PRIOR_SD.items()}, PRIOR_SD["standard"][i])


def _pow(base_pct: str, exponent: Column) -> Column:
    return F.pow(F.lit(1.0) + F.col(base_pct) / 100.0, exponent)


def project(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """M1/M2: constant-elasticity multipliers and the projected volume."""
    seg = F.col("segment")
    elec = F.col("fuel_type").isin(list(spec.electrified_fuels))
    own, inc = _prior(0, seg), _prior(1, seg)
    fuel_e = F.when(elec, _prior(3, seg)).otherwise(_prior(2, seg))
    reg = _prior(4, seg)
    reg_dir = F.when(elec, F.lit(1.0)).otherwise(F.lit(-1.0))
    out = rows.withColumns({
        "price_mult": _pow("price_change_pct", own),
        "income_mult": _pow("gdp_growth_pct", inc),
        "fuel_mult": _pow("fuel_price_change_pct", fuel_e),
        "regulation_mult": F.greatest(F.lit(1.0) + reg_dir * reg * (F.col("regulation_change_pts") / 10.0),
                                      F.lit(0.0)),
        "fx_mult": _pow("fx_depreciation_pct", own),
    })
    projected = (F.col("base_volume") * F.col("price_mult") * F.col("income_mult") * F.col("fuel_mult")
                 * F.col("regulation_mult") * F.col("fx_mult"))
    out = out.withColumn("projected_volume", projected)
    return out.withColumn("total_change_pct", F.when(
        F.col("base_volume") == 0, F.lit(0.0)).otherwise((F.col("projected_volume") / F.col("base_volume") - 1.0)
                                                         * 100.0))


MULT_COLS = ("price_mult", "income_mult", "fuel_mult", "regulation_mult", "fx_mult")
KEYS = ("scenario_id", "region", "fuel_type", "segment")


def driver_effects(projected: DataFrame) -> DataFrame:
    """M3: long form (driver, multiplier, pct_effect = (multiplier − 1)·100)."""
    arr = F.array(*[F.struct(F.lit(d).alias("driver"), F.col(m).alias("multiplier"))
                    for d, m in zip(DRIVERS, MULT_COLS)])
    return projected.select(*KEYS, F.explode(arr).alias("e")).select(
        *KEYS, "e.driver", "e.multiplier", ((F.col("e.multiplier") - 1.0) * 100.0).alias("pct_effect")
    )


def top_drivers(projected: DataFrame, k: int = 3) -> DataFrame:
    """per scenario row, the k largest |effects| above the materiality cut.

    Sorting the five effects is an array expression inside each row (no window,
    no shuffle); ties keep the driver order.
    """
    arr = F.array(*[F.struct((-F.abs((F.col(m) - 1.0) * 100.0)).alias("neg"), F.lit(i).alias("pos"),
                             F.lit(d).alias("driver"), ((F.col(m) - 1.0) * 100.0).alias("pct_effect"))
                    for i, (d, m) in enumerate(zip(DRIVERS, MULT_COLS))])
    material = F.filter(F.sort_array(arr), lambda s: F.abs(s["pct_effect"]) > MATERIAL_EFFECT_PCT)
    ranked = projected.select(*KEYS, F.posexplode(F.slice(material, 1, k)).alias("rank0", "d"))
    return ranked.select(*KEYS, (F.col("rank0") + 1).alias("rank"), "d.driver", "d.pct_effect")


def monte_carlo(rows: DataFrame, spec: TableSpec, *, n_draws: int = N_DRAWS, seed: int = 42,
                chunk: int = DRAW_CHUNK) -> DataFrame:
    """M4: projected volume per draw of Gaussian elasticities.

    Draws are keyed by (seed, draw index, parameter) only, so every scenario
    sees the same elasticity draws; the same own-price draw drives the price
    and FX terms and the regulation multiplier is floored at 0. Rows are split
    into chunks of draws and repartitioned before the draws are generated, so
    the exploded rows spread over the cluster.
    """
    seg = F.col("segment")
    elec = F.col("fuel_type").isin(list(spec.electrified_fuels))
    n_chunks = (n_draws + chunk - 1) // chunk
    spread = (rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
              .repartition(*[F.col(c) for c in KEYS], F.col("chunk")))
    draws = spread.withColumn("draw", F.explode(F.sequence(
        F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.lit(n_draws)) - 1)))

    # The standard-normal draws depend only on the draw index: one row per draw
    # (bounded by ``n_draws``), computed once and broadcast.
    def z(name: str) -> Column:
        return hash_normal(F.lit("draw"), F.lit(seed), F.col("draw"), F.lit(name)).alias(f"z_{name}")

    spark = rows.sparkSession
    normals = spark.range(n_draws).select(F.col("id").cast("int").alias("draw")).select(
        "draw", z("own_price"), z("income"), z("fuel"), z("regulation"))
    draws = draws.join(F.broadcast(normals), "draw")

    own = _prior(0, seg) + _prior_sd(0, seg) * F.col("z_own_price")
    inc = _prior(1, seg) + _prior_sd(1, seg) * F.col("z_income")
    fuel_e = F.when(elec, _prior(3, seg)).otherwise(_prior(2, seg)) + _prior_sd(2, seg) * F.col("z_fuel")
    reg = _prior(4, seg) + _prior_sd(3, seg) * F.col("z_regulation")
    reg_dir = F.when(elec, F.lit(1.0)).otherwise(F.lit(-1.0))
    volume = (F.col("base_volume") * _pow("price_change_pct", own) * _pow("gdp_growth_pct", inc)
              * _pow("fuel_price_change_pct", fuel_e) * _pow("fx_depreciation_pct", own)
              * F.greatest(F.lit(1.0) + reg_dir * reg * (F.col("regulation_change_pts") / 10.0), F.lit(0.0)))
    return draws.select(*KEYS, "base_volume", "draw", volume.alias("projected_volume"))


def draw_percentiles(draws: DataFrame) -> DataFrame:
    """M5: p2.5/p10/p50/p90/p97.5 per scenario row and % change bounds.

    ``percentile`` is exact (linear interpolation); its per-group input is the
    number of draws, a parameter, so the value map per group is bounded.
    """
    qs = list(PERCENTILES.values())
    agg = draws.groupBy(*KEYS).agg(F.first("base_volume").alias("base_volume"),
                                   F.percentile("projected_volume", qs).alias("_p"),
                                   F.count(F.lit(1)).alias("n_draws"))
    cols = [F.col("_p")[i].alias(name) for i, name in enumerate(PERCENTILES)]
    out = agg.select(*KEYS, "base_volume", "n_draws", *cols)
    pct = lambda c: F.when(F.col("base_volume") == 0, F.lit(0.0)).otherwise(
        (F.col(c) / F.col("base_volume") - 1.0) * 100.0)
    return out.withColumns({"ci80_low_pct": pct("p10"), "ci80_high_pct": pct("p90")})


def narrative(projected: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """M6: one text per scenario row: its two volumes, the leading drivers, the 80% range and what kind of number this is."""
    change = F.col("total_change_pct")
    direction = F.when(change > FLAT_BAND_PCT, "rise").when(change < -FLAT_BAND_PCT, "fall").otherwise("stay broadly flat")
    leading = top_drivers(projected, 2).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("rank", "driver", "pct_effect"))).alias("leading"))
    rows = projected.join(leading, list(KEYS), "left")
    parts = [F.format_string("%s, %s: %,.0f units become %,.0f, so volumes %s (%+.1f%%).", F.col("region"), F.col("fuel_type"), F.col("base_volume"),
                             F.col("projected_volume"), direction, change)]
    named = F.transform("leading", lambda x: F.format_string("%s %+.1f%%", F.lower(x["driver"]), x["pct_effect"]))
    parts.append(F.when(F.size(F.coalesce("leading", F.array())) > 0, F.concat(F.lit("Leading drivers: "), F.array_join(named, ", "), F.lit(".")))
                 .otherwise(F.lit("Leading drivers: none.")))
    if intervals is not None:
        rows = rows.join(intervals.select(*KEYS, "ci80_low_pct", "ci80_high_pct"), list(KEYS), "left")
        parts.append(F.format_string("Four draws in five lie between %+.0f%% and %+.0f%%.", F.col("ci80_low_pct"), F.col("ci80_high_pct")))
    parts.append(F.lit("A what-if from fixed elasticities; nothing here was fitted to the rows."))
    return rows.select(*KEYS, direction.alias("direction"), F.concat_ws(" ", *parts).alias("narrative"))


DEFAULT_SCENARIOS = (
    Scenario("no_change"),
    Scenario("price_up_10", price_change_pct=10.0),
    Scenario("income_up_10", gdp_growth_pct=10.0),
    Scenario("regulation_up_20", regulation_change_pts=20.0),
    Scenario("mixed", price_change_pct=5.0, gdp_growth_pct=2.0, fuel_price_change_pct=10.0,
             regulation_change_pts=5.0, fx_depreciation_pct=3.0),
)
