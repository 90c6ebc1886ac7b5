"""Queries: the five SQL reports and their variants."""

from __future__ import annotations

from ledgerlens.operators import reports
from ledgerlens.plans.catalogue import facts, register
from ledgerlens.plans.oracle import ELECTRIFIED_SQL, with_sales

register(
    "top_regions_by_volume", "D1 E2 F1",
    with_sales("""
SELECT Region AS region,
       COUNT(*) AS n_records,
       CAST(SUM(Sales_Volume) AS BIGINT) AS total_volume,
       ROUND(AVG(Sales_Volume), 1) AS avg_volume,
       ROUND(100.0 * CAST(SUM(Sales_Volume) AS DOUBLE) / SUM(SUM(Sales_Volume)) OVER (), 2) AS pct_of_total
FROM sales GROUP BY Region ORDER BY total_volume DESC"""),
)(lambda spark, d: reports.top_regions_by_volume(facts(spark, d)))

register(
    "electrification_by_region", "D2 H1",
    with_sales(f"""
SELECT Region AS region,
       CAST(SUM(Sales_Volume) AS BIGINT) AS total_volume,
       CAST(SUM(CASE WHEN Fuel_Type IN ({ELECTRIFIED_SQL}) THEN Sales_Volume ELSE 0 END) AS BIGINT) AS electrified_volume,
       ROUND(100.0 * CAST(SUM(CASE WHEN Fuel_Type IN ({ELECTRIFIED_SQL}) THEN Sales_Volume ELSE 0 END) AS DOUBLE)
             / NULLIF(SUM(Sales_Volume), 0), 2) AS electrified_pct
FROM sales GROUP BY Region ORDER BY electrified_pct DESC"""),
)(lambda spark, d: reports.electrification_by_region(facts(spark, d)))

register(
    "high_rate_by_region", "D3",
    with_sales("""
SELECT Region AS region,
       COUNT(*) AS n,
       CAST(SUM(CASE WHEN Sales_Classification = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
       ROUND(100.0 * AVG(CASE WHEN Sales_Classification = 'High' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS high_pct
FROM sales GROUP BY Region ORDER BY high_pct DESC"""),
)(lambda spark, d: reports.high_rate_by_region(facts(spark, d)))

register(
    "price_stats_by_model", "D4 E6",
    with_sales("""
SELECT Model AS model,
       COUNT(*) AS n,
       ROUND(AVG(Price_USD), 0) AS avg_price_usd,
       ROUND(quantile_cont(Price_USD, 0.25), 0) AS p25_price_usd,
       ROUND(quantile_cont(Price_USD, 0.50), 0) AS median_price_usd,
       ROUND(quantile_cont(Price_USD, 0.75), 0) AS p75_price_usd
FROM sales GROUP BY Model ORDER BY avg_price_usd DESC"""),
)(lambda spark, d: reports.price_stats_by_model(facts(spark, d)))

register(
    "yoy_volume", "D5 E1 H3",
    with_sales("""
SELECT year, total_volume,
       total_volume - LAG(total_volume) OVER (ORDER BY year) AS yoy_delta,
       ROUND(100.0 * (total_volume - LAG(total_volume) OVER (ORDER BY year))
             / NULLIF(LAG(total_volume) OVER (ORDER BY year), 0), 2) AS yoy_pct
FROM (SELECT Year AS year, CAST(SUM(Sales_Volume) AS BIGINT) AS total_volume FROM sales GROUP BY Year) yearly
ORDER BY year"""),
)(lambda spark, d: reports.yoy_volume(facts(spark, d)))

register(
    "yoy_volume_by_region", "E1",
    with_sales("""
SELECT region, year, total_volume,
       total_volume - LAG(total_volume) OVER (PARTITION BY region ORDER BY year) AS yoy_delta,
       ROUND(100.0 * (total_volume - LAG(total_volume) OVER (PARTITION BY region ORDER BY year))
             / NULLIF(LAG(total_volume) OVER (PARTITION BY region ORDER BY year), 0), 2) AS yoy_pct
FROM (SELECT Region AS region, Year AS year, CAST(SUM(Sales_Volume) AS BIGINT) AS total_volume
      FROM sales GROUP BY Region, Year) yearly
ORDER BY region, year"""),
)(lambda spark, d: reports.yoy_volume(facts(spark, d), by=["Region"]))


def _price_stats_approximate(spark, d):
    """D4 with the named approximate option: quartiles from quantile sketches by model and year, merged by model."""
    from ledgerlens.operators import ranks
    from ledgerlens.plans.oracle import SPEC

    parts = ranks.quantile_sketches(facts(spark, d), [SPEC.model, SPEC.year], SPEC.price)
    merged = ranks.merge_sketches(parts, [SPEC.model])
    return ranks.approximate_percentiles(merged, {"q1": 0.25, "median": 0.5, "q3": 0.75})


register("price_stats_approximate", "D4 D15")(_price_stats_approximate)
