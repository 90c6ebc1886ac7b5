"""Queries: slices, KPIs, profile, reshaping, sampling and top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import profile as P
from ledgerlens.plans.catalogue import facts, register
from ledgerlens.plans.oracle import ELECTRIFIED_SQL, SPEC, with_sales

FACT_COLS = list(SPEC.fact_columns)
SLICE_REGIONS = ["ASIA", "EUROPE"]
SLICE_FUELS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
SLICE_YEARS = (1996, 1999)
HIST_BINS = 40
SAMPLE_N, SAMPLE_SEED = 500, 42

ALL_COLS_SQL = ", ".join(FACT_COLS + ["row_key"])


register(
    "sliced_facts", "B1",
    with_sales(f"""
SELECT {ALL_COLS_SQL} FROM sales
WHERE Region IN ('ASIA', 'EUROPE') AND Fuel_Type IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
  AND Year BETWEEN {SLICE_YEARS[0]} AND {SLICE_YEARS[1]}"""),
)(lambda spark, d: P.slice_facts(facts(spark, d), SPEC, SLICE_REGIONS, SLICE_FUELS, *SLICE_YEARS))

register(
    "sliced_facts_empty_selection", "B1",
    with_sales(f"SELECT {ALL_COLS_SQL} FROM sales WHERE FALSE"),
)(lambda spark, d: P.slice_facts(facts(spark, d), SPEC, [], SLICE_FUELS, *SLICE_YEARS))

register(
    "filter_domains", "B2",
    with_sales("""
SELECT DISTINCT 'region' AS kind, Region AS value FROM sales
UNION ALL SELECT DISTINCT 'fuel_type', Fuel_Type FROM sales
UNION ALL SELECT 'year_min', CAST(min(Year) AS VARCHAR) FROM sales
UNION ALL SELECT 'year_max', CAST(max(Year) AS VARCHAR) FROM sales"""),
)(lambda spark, d: P.filter_domains(facts(spark, d), SPEC))

KPI_SQL = f"""
SELECT COUNT(*) AS n_rows,
       ROUND(AVG(CAST(Price_USD AS DOUBLE)), 6) AS mean_price,
       CAST(SUM(Sales_Volume) AS BIGINT) AS total_volume,
       ROUND(AVG(CASE WHEN Fuel_Type IN ({ELECTRIFIED_SQL}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0, 6)
         AS electrified_share_pct,
       COUNT(DISTINCT Model) AS n_models
FROM sales"""

register("kpi_row", "D6 D16", with_sales(KPI_SQL))(lambda spark, d: P.kpi_row(facts(spark, d), SPEC))

register(
    "kpi_long", "B16 D6",
    with_sales(f"""
SELECT metric, value FROM (
  SELECT CAST(n_rows AS DOUBLE) AS n_rows, CAST(mean_price AS DOUBLE) AS mean_price,
         CAST(total_volume AS DOUBLE) AS total_volume, CAST(electrified_share_pct AS DOUBLE) AS electrified_share_pct,
         CAST(n_models AS DOUBLE) AS n_models FROM ({KPI_SQL}) k
) UNPIVOT (value FOR metric IN (n_rows, mean_price, total_volume, electrified_share_pct, n_models))"""),
)(lambda spark, d: P.unpivot_long(
    P.kpi_row(facts(spark, d), SPEC), [],
    ["n_rows", "mean_price", "total_volume", "electrified_share_pct", "n_models"],
))

MODEL_METRICS = ["n", "mean_price", "total_volume"]


def _model_stats_wide(spark, d):
    f = facts(spark, d)
    stats = f.groupBy(F.col(SPEC.model).alias("model")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col(SPEC.price).cast("double")), 6).alias("mean_price"),
        F.sum(SPEC.volume).alias("total_volume"),
    )
    long = P.unpivot_long(stats, ["model"], MODEL_METRICS)
    return P.pivot_wide(long, "model", "metric", "value", MODEL_METRICS)


register(
    "model_stats_wide", "B17 B16",
    with_sales("""
SELECT Model AS model, CAST(COUNT(*) AS DOUBLE) AS n,
       CAST(ROUND(AVG(CAST(Price_USD AS DOUBLE)), 6) AS DOUBLE) AS mean_price,
       CAST(SUM(Sales_Volume) AS DOUBLE) AS total_volume
FROM sales GROUP BY Model"""),
)(_model_stats_wide)

register(
    "volume_by_region_asc", "D7",
    with_sales("""
SELECT Region AS region, CAST(SUM(Sales_Volume) AS BIGINT) AS total_volume
FROM sales GROUP BY Region ORDER BY total_volume"""),
)(lambda spark, d: P.volume_by(facts(spark, d), SPEC, [SPEC.region]))

register(
    "volume_by_year_fuel", "D8",
    with_sales("""
SELECT Year AS year, Fuel_Type AS fuel_type, CAST(SUM(Sales_Volume) AS BIGINT) AS total_volume
FROM sales GROUP BY Year, Fuel_Type"""),
)(lambda spark, d: P.volume_by(facts(spark, d), SPEC, [SPEC.year, SPEC.fuel]))

register(
    "mean_price_by_model", "D9 F1",
    with_sales("""
SELECT Model AS model, ROUND(AVG(CAST(Price_USD AS DOUBLE)), 6) AS mean_price
FROM sales GROUP BY Model ORDER BY mean_price DESC"""),
)(lambda spark, d: P.mean_price_by_model(facts(spark, d), SPEC))

register(
    "price_histogram", "D10",
    with_sales(f"""
SELECT CAST(b AS INT) AS bin,
       ROUND(lo + b * ((hi - lo) / {HIST_BINS}), 6) AS bin_lo,
       ROUND(lo + (b + 1) * ((hi - lo) / {HIST_BINS}), 6) AS bin_hi,
       COUNT(*) AS n
FROM (
  SELECT CASE WHEN hi > lo THEN least(floor((Price_USD - lo) / (hi - lo) * {HIST_BINS}), {HIST_BINS - 1})
              ELSE 0 END AS b, lo, hi
  FROM sales, (SELECT CAST(min(Price_USD) AS DOUBLE) AS lo, CAST(max(Price_USD) AS DOUBLE) AS hi FROM sales) mm
) t GROUP BY b, lo, hi"""),
)(lambda spark, d: P.histogram(facts(spark, d), SPEC.price, HIST_BINS))

register(
    "region_fuel_contingency", "D11",
    with_sales("""
SELECT r.region, f.fuel_type, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT Region AS region FROM sales) r
CROSS JOIN (SELECT DISTINCT Fuel_Type AS fuel_type FROM sales) f
LEFT JOIN (SELECT Region, Fuel_Type, COUNT(*) AS n FROM sales GROUP BY Region, Fuel_Type) c
  ON c.Region = r.region AND c.Fuel_Type = f.fuel_type"""),
)(lambda spark, d: P.contingency(facts(spark, d), SPEC.region, SPEC.fuel))

_NULL_PARTS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(SUM(CASE WHEN {c} IS NULL"
    + (f" OR isnan({c})" if c in (SPEC.engine, SPEC.price) else "")
    + f" THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM sales"
    for c in FACT_COLS
)
_NULL_TOTAL = " + ".join(
    f"SUM(CASE WHEN {c} IS NULL" + (f" OR isnan({c})" if c in (SPEC.engine, SPEC.price) else "") + " THEN 1 ELSE 0 END)"
    for c in FACT_COLS
)
register(
    "null_cells", "D12",
    with_sales(f"{_NULL_PARTS} UNION ALL SELECT '__total__', CAST({_NULL_TOTAL} AS BIGINT) FROM sales"),
)(lambda spark, d: P.null_cells(facts(spark, d), FACT_COLS))

register(
    "duplicate_rows", "D13",
    with_sales(f"""
SELECT CAST(coalesce(SUM(cnt - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT COUNT(*) AS cnt FROM sales GROUP BY {', '.join(FACT_COLS)}) g"""),
)(lambda spark, d: P.duplicate_rows(facts(spark, d), FACT_COLS))

register(
    "table_shape", "D14",
    with_sales(f"SELECT COUNT(*) AS n_rows, {len(FACT_COLS) + 1} AS n_cols FROM sales"),
)(lambda spark, d: P.table_shape(facts(spark, d)))

_NUM_PARTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, COUNT(DISTINCT CAST({c} AS DOUBLE)) AS n_unique,
       ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS mean, ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS std,
       CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max FROM sales"""
    for c in SPEC.numeric
)
register("numeric_profile", "D15", with_sales(_NUM_PARTS))(
    lambda spark, d: P.numeric_profile(facts(spark, d), list(SPEC.numeric))
)

_CAT_PARTS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS cnt FROM sales "
    f"WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in SPEC.categorical
)
register(
    "categorical_profile", "D15",
    with_sales(f"""
SELECT column_name, CAST(SUM(cnt) AS BIGINT) AS count, COUNT(*) AS n_unique,
       (list(value ORDER BY cnt DESC, value ASC))[1] AS top, CAST(MAX(cnt) AS BIGINT) AS freq
FROM ({_CAT_PARTS}) v GROUP BY column_name"""),
)(lambda spark, d: P.categorical_profile(facts(spark, d), list(SPEC.categorical)))

register(
    "seeded_sample", "B18",
    with_sales(f"SELECT {ALL_COLS_SQL} FROM sales ORDER BY md5(row_key || ':{SAMPLE_SEED}') LIMIT {SAMPLE_N}"),
)(lambda spark, d: P.seeded_sample(facts(spark, d), "row_key", SAMPLE_N, SAMPLE_SEED))

register(
    "first_rows_by_key", "B19",
    with_sales(f"SELECT {ALL_COLS_SQL} FROM sales ORDER BY row_key LIMIT 20"),
)(lambda spark, d: P.first_rows(facts(spark, d), "row_key", 20))

register(
    "top_models_by_price", "F2",
    with_sales("""
SELECT Model AS model, ROUND(AVG(CAST(Price_USD AS DOUBLE)), 6) AS mean_price
FROM sales GROUP BY Model ORDER BY mean_price DESC LIMIT 6"""),
)(lambda spark, d: P.top_n(P.mean_price_by_model(facts(spark, d), SPEC), "mean_price", 6))

register(
    "best_model_by_region", "F5",
    with_sales("""
SELECT region, (list(model ORDER BY total_volume DESC, model ASC))[1] AS best_model,
       MAX(total_volume) AS best_total_volume
FROM (SELECT Region AS region, Model AS model, CAST(SUM(Sales_Volume) AS BIGINT) AS total_volume
      FROM sales GROUP BY Region, Model) t GROUP BY region"""),
)(lambda spark, d: P.argmax_by_group(
    P.volume_by(facts(spark, d), SPEC, [SPEC.region, SPEC.model]), "region", "model", "total_volume"
))
