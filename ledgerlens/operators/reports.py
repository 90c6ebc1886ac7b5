"""The named SQL reports (D1–D5, E1, E2, F1) as DataFrame jobs.

Each report is one partial+final hash aggregate on the fact table; windows run
on the aggregated frame, whose size is the number of groups (regions, years),
never the number of facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import exact_percentiles
from ledgerlens.spec import TPCH_SPEC, TableSpec


def _electrified(spec: TableSpec):
    return F.col(spec.fuel).isin(list(spec.electrified_fuels))


def top_regions_by_volume(facts: DataFrame, spec: TableSpec = TPCH_SPEC) -> DataFrame:
    """Records, total and mean volume per region, share of the grand total."""
    per_region = facts.groupBy(F.col(spec.region).alias("region")).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(spec.volume).cast("long").alias("total_volume"),
        F.round(F.avg(spec.volume), 1).alias("avg_volume"),
    )
    grand = F.sum("total_volume").over(Window.partitionBy())  # rows = regions
    return per_region.withColumn(
        "pct_of_total", F.round(F.lit(100.0) * F.col("total_volume") / grand, 2)
    ).orderBy(F.desc("total_volume"))


def electrification_by_region(facts: DataFrame, spec: TableSpec = TPCH_SPEC) -> DataFrame:
    """Electrified share of volume per region, percent."""
    elec = F.sum(F.when(_electrified(spec), F.col(spec.volume)).otherwise(F.lit(0)))
    out = facts.groupBy(F.col(spec.region).alias("region")).agg(
        F.sum(spec.volume).cast("long").alias("total_volume"),
        elec.cast("long").alias("electrified_volume"),
    )
    pct = F.try_divide(F.lit(100.0) * F.col("electrified_volume"), F.col("total_volume"))
    return out.withColumn("electrified_pct", F.round(pct, 2)).orderBy(F.desc("electrified_pct"))


def high_rate_by_region(facts: DataFrame, spec: TableSpec = TPCH_SPEC) -> DataFrame:
    """D3: positive-label count and rate per region (double arithmetic, not decimal)."""
    is_high = F.col(spec.label) == F.lit(spec.positive_label)
    return (
        facts.groupBy(F.col(spec.region).alias("region"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(is_high, 1).otherwise(0)).cast("long").alias("n_high"),
            F.round(F.lit(100.0) * F.avg(F.when(is_high, 1.0).otherwise(0.0)), 2).alias("high_pct"),
        )
        .orderBy(F.desc("high_pct"))
    )


def price_stats_by_model(facts: DataFrame, spec: TableSpec = TPCH_SPEC) -> DataFrame:
    """Count, mean and exact quartiles (linear interpolation) of price per model.

    Quartiles are selected by counting value buckets, so the rows are neither sorted
    nor shuffled, whatever share of them a model holds.
    """
    base = facts.select(F.col(spec.model).alias("model"), F.col(spec.price).cast("double").alias("price"))
    stats = base.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 0).alias("avg_price_usd")
    )
    q = exact_percentiles(base, ["model"], "price", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return (
        stats.join(q, "model")
        .select(
            "model", "n", "avg_price_usd",
            F.round("p25", 0).alias("p25_price_usd"),
            F.round("p50", 0).alias("median_price_usd"),
            F.round("p75", 0).alias("p75_price_usd"),
        )
        .orderBy(F.desc("avg_price_usd"))
    )


def yearly_volume(facts: DataFrame, spec: TableSpec = TPCH_SPEC, by: list[str] | None = None) -> DataFrame:
    """Total volume per year (optionally per extra keys)."""
    keys = [F.col(c).alias(c.lower()) for c in (by or [])]
    return facts.groupBy(*keys, F.col(spec.year).alias("year")).agg(
        F.sum(spec.volume).cast("long").alias("total_volume")
    )


def yoy_volume(facts: DataFrame, spec: TableSpec = TPCH_SPEC, by: list[str] | None = None) -> DataFrame:
    """Year-over-year delta and percent change; the first year is NULL.

    ``by`` adds a partition key (e.g. region) so the window runs per group; the
    window input is the yearly aggregate (one row per year and group).
    """
    yearly = yearly_volume(facts, spec, by)
    part = [c.lower() for c in (by or [])]
    w = Window.partitionBy(*part).orderBy("year")
    prev = F.lag("total_volume").over(w)
    delta = F.col("total_volume") - prev
    pct = F.round(F.lit(100.0) * delta / F.nullif(prev, F.lit(0)), 2)
    return yearly.select(*part, "year", "total_volume", delta.alias("yoy_delta"), pct.alias("yoy_pct")).orderBy(
        *part, "year"
    )


REPORTS = {
    "top_regions_by_volume": top_regions_by_volume,
    "electrification_by_region": electrification_by_region,
    "high_rate_by_region": high_rate_by_region,
    "price_stats_by_model": price_stats_by_model,
    "yoy_volume": yoy_volume,
}
