"""Queries: loading, coercion, SQL-text views, JSON payloads, cache, provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions.hashrand import sha1_seed
from ledgerlens.operators import panel as PN
from ledgerlens.plans.catalogue import facts, facts_signature, register
from ledgerlens.plans.oracle import SPEC, with_sales
from ledgerlens.plans.q_panel import panel_sql
from ledgerlens.session import checkpoint_dir
from ledgerlens.sources import facts as SRC
from ledgerlens.sources import payloads as PL


def _coerced(spark, d):
    f = SRC.coerce_types(facts(spark, d))
    return f.select(*SPEC.fact_columns, "row_key")


register(
    "coerced_facts", "A3",
    with_sales("""
SELECT Model, CAST(Year AS SMALLINT) AS Year, Region, Color, Fuel_Type, Transmission,
       CAST(Engine_Size_L AS FLOAT) AS Engine_Size_L, CAST(Mileage_KM AS INT) AS Mileage_KM,
       CAST(trunc(Price_USD) AS INT) AS Price_USD, CAST(Sales_Volume AS INT) AS Sales_Volume,
       Sales_Classification, row_key
FROM sales"""),
)(_coerced)

# A report as SQL text over a registered view (A4/A5).
_VIEW_SQL = """
WITH per_region AS (SELECT Region AS region, COUNT(*) AS n_records, SUM(Sales_Volume) AS volume FROM {view} GROUP BY Region),
     overall AS (SELECT SUM(volume) AS volume FROM per_region)
SELECT p.region, p.n_records, CAST(p.volume AS BIGINT) AS total_volume, ROUND(p.volume * 1.0D / p.n_records, 1) AS avg_volume,
       ROUND(p.volume * 100.0D / o.volume, 2) AS pct_of_total
FROM per_region p CROSS JOIN overall o"""


def _view_report(spark, d):
    """The facts landed as CSV, viewed with inferred types, and the report run on the view."""
    path = f"{checkpoint_dir(spark)}/ledgerlens-stage/view-{uuid.uuid4().hex}.csv"
    facts(spark, d).select(*SPEC.fact_columns).write.option("header", True).csv(path)
    view = "ledgerlens_sales_view"
    SRC.register_view(spark, path, view)
    return spark.sql(_VIEW_SQL.format(view=view))


register("sql_view_top_regions", "A4 A5",
         with_sales("""
SELECT Region AS region, COUNT(*) AS n_records, CAST(sum(Sales_Volume) AS BIGINT) AS total_volume, ROUND(avg(Sales_Volume), 1) AS avg_volume,
       ROUND(CAST(100.0 AS DOUBLE) * sum(Sales_Volume) / (SELECT sum(Sales_Volume) FROM sales), 2) AS pct_of_total
FROM sales GROUP BY Region"""))(_view_report)


register(
    "sha1_seeds", "H5",
    with_sales("""
SELECT DISTINCT Region AS region, Year AS year,
       CAST('0x' || substr(sha1(Region || '|' || CAST(Year AS VARCHAR) || '|42'), 1, 8) AS BIGINT) AS seed FROM sales"""),
)(lambda spark, d: facts(spark, d).select(F.col(SPEC.region).alias("region"), F.col(SPEC.year).alias("year")).distinct()
  .withColumn("seed", sha1_seed(F.col("region"), F.col("year"), 42)))


def _payload_obs(spark, d):
    f = facts(spark, d)
    window = PN.year_window(f, SPEC)
    parsed, _ = PL.parse_indicator_payloads(PL.indicator_payloads(f, SPEC, window))
    return parsed


_YEARLY = """SELECT Region AS region, Fuel_Type AS fuel_type, Year AS year,
       CAST(SUM(Sales_Volume) AS DOUBLE) AS value FROM sales GROUP BY Region, Fuel_Type, Year"""
register("indicator_payload_observations", "A7", with_sales(_YEARLY))(_payload_obs)


def _payload_rejects(spark, d):
    f = facts(spark, d)
    window = PN.year_window(f, SPEC)
    _, rejects = PL.parse_indicator_payloads(PL.indicator_payloads(f, SPEC, window))
    return rejects.select("region", "fuel_type", "reason")


register("indicator_payload_rejects", "A7",
         with_sales("SELECT Region AS region, Fuel_Type AS fuel_type, 'x' AS reason FROM sales WHERE FALSE"))(
    _payload_rejects
)


def _fx_parse(spark, d):
    f = facts(spark, d)
    panel, _, _ = PN.build_external_panel(f, SPEC)
    parsed, _ = PL.parse_fx_payloads(PL.fx_payloads(panel.select("region", "year", "usd_per_unit")))
    return parsed


register("fx_payload_rates", "A8", panel_sql("SELECT region, year, usd_per_unit FROM panel"))(_fx_parse)


def _event_props(spark, d):
    ev = SRC.table(spark, d, "events").select("event_id", "event_type", "props")
    return PL.json_field(ev, "props", "$.k", "k", "int").select("event_id", "event_type", "k")


register("event_props_k", "A8",
         "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(_event_props)


def _event_props_by_type(spark, d):
    ev = PL.json_field(SRC.table(spark, d, "events").select("event_type", "props"), "props", "$.k", "k", "int")
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").cast("long").alias("sum_k"),
        F.round(F.avg("k"), 6).alias("avg_k"),
    )


register(
    "event_props_by_type", "A8",
    """SELECT event_type, COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS sum_k, ROUND(AVG(k), 6) AS avg_k
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e GROUP BY event_type""",
)(_event_props_by_type)


# Envelopes of every kind of badness, one per event (A7): rows of ``events`` choose the kind.
def _event_envelopes(spark, d):
    ev = SRC.table(spark, d, "events").select("event_id", "props", F.get_json_object("props", "$.k").alias("k"))
    year = (F.lit(2000) + F.col("event_id") % 20).cast("string")
    one = lambda date, value: F.concat(F.lit('[{"page":1},[{"date":"'), date, F.lit('","value":'), value, F.lit("}]]"))
    kind = F.col("event_id") % 8
    raw = (F.when(kind == 0, one(year, F.col("k"))).when(kind == 1, F.col("props"))
           .when(kind == 2, F.concat(F.lit("["), F.col("props"), F.lit(',"text"]')))
           .when(kind == 3, F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]")))
           .when(kind == 4, one(F.concat(year, F.lit("Q1")), F.col("k")))
           .when(kind == 5, one(year, F.lit('"n/a"'))).when(kind == 6, one(year, F.lit("null")))
           .otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]"))))
    return ev.select("event_id", raw.alias("raw"))


register("event_payload_observations", "A7", """
SELECT event_id, CAST(2000 + event_id % 20 AS INT) AS year, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value
FROM events WHERE event_id % 8 = 0 AND json_extract_string(props, '$.k') IS NOT NULL""")(
    lambda spark, d: PL.parse_indicator_payloads(_event_envelopes(spark, d))[0]
)
register("event_payload_rejects", "A7", """
SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'not a JSON array' WHEN 2 THEN 'observation list is not an array'
                                   WHEN 3 THEN 'observation list is not an array' WHEN 4 THEN 'date is not a year'
                                   WHEN 5 THEN 'value is not a number' ELSE 'envelope shorter than 2' END AS reason
FROM events WHERE event_id % 8 NOT IN (0, 6)""")(
    lambda spark, d: PL.parse_indicator_payloads(_event_envelopes(spark, d))[1].select("event_id", "reason")
)


# -- A9–A11 ------------------------------------------------------------------------
def _landed_volume_index(spark, d):
    """Live rows: parsed payload observations; cache rows: earlier, doubled values of the
    even years; mock rows: the full key×year spine at 0. Even years so have all three."""
    f = facts(spark, d)
    window = PN.year_window(f, SPEC)
    live, _ = PL.parse_indicator_payloads(PL.indicator_payloads(f, SPEC, window))
    cache = live.where(F.col("year") % 2 == 0).withColumn("value", F.col("value") * 2)
    keys = f.select(F.col(SPEC.region).alias("region"), F.col(SPEC.fuel).alias("fuel_type"))
    mock = PN.spine(keys, window).withColumn("value", F.lit(0.0))
    landed = None
    for tag, rows in (("live", live), ("cache", cache), ("mock", mock)):
        rows = rows.withColumn("provenance", F.lit(tag))
        landed = rows if landed is None else landed.unionByName(rows)
    return landed.withColumn("source", F.lit("volume_index"))


def _resolved(spark, d):
    landed = _landed_volume_index(spark, d)
    return PN.resolve_precedence(landed, ["source", "region", "fuel_type", "year"]).drop("source")


_RESOLVED_SQL = """
resolved AS (
  SELECT k.region, k.fuel_type, CAST(g.year AS INT) AS year,
         CASE WHEN y.value IS NULL THEN 0.0 WHEN g.year % 2 = 0 THEN y.value * 2 ELSE y.value END AS value,
         CASE WHEN y.value IS NULL THEN 'mock' WHEN g.year % 2 = 0 THEN 'cache' ELSE 'live' END AS provenance
  FROM (SELECT DISTINCT Region AS region, Fuel_Type AS fuel_type FROM sales) k
  CROSS JOIN (SELECT unnest(generate_series(min(Year), max(Year))) AS year FROM sales) g
  LEFT JOIN (""" + _YEARLY + """) y ON y.region = k.region AND y.fuel_type = k.fuel_type AND y.year = g.year
)"""
register("volume_index_precedence", "A9",
         with_sales("SELECT region, fuel_type, year, value, provenance FROM resolved", extra_ctes=_RESOLVED_SQL.strip()))(
    _resolved
)


def _provenance_rows(spark, d):
    resolved = _resolved(spark, d).select(F.lit("volume_index").alias("source"), "provenance")
    f = facts(spark, d)
    _, _, panel_prov = PN.build_external_panel(f, SPEC, PN.year_window(f, SPEC))
    return panel_prov.unionByName(resolved)


_PROV_ROWS = """
prov AS (
  SELECT 'worldbank' AS source, 'mock' AS provenance UNION ALL SELECT 'fuel_prices', 'mock'
  UNION ALL SELECT 'co2_regulations', 'mock' UNION ALL SELECT 'fx_rates', 'mock'
  UNION ALL SELECT 'volume_index', provenance FROM resolved
)"""
register(
    "provenance_by_source", "A10",
    with_sales("""
SELECT source, (list(provenance ORDER BY CASE provenance WHEN 'live' THEN 0 WHEN 'cache' THEN 1 WHEN 'mock' THEN 2
                ELSE 3 END DESC))[1] AS provenance
FROM prov GROUP BY source""", extra_ctes=_RESOLVED_SQL.strip() + "," + _PROV_ROWS),
)(lambda spark, d: PN.weakest_provenance(_provenance_rows(spark, d)))

register(
    "provenance_summary", "A11",
    with_sales("""
SELECT provenance, string_agg(source, ', ' ORDER BY source) AS sources
FROM (SELECT DISTINCT source, provenance FROM prov) p GROUP BY provenance""",
               extra_ctes=_RESOLVED_SQL.strip() + "," + _PROV_ROWS),
)(lambda spark, d: PN.provenance_summary(_provenance_rows(spark, d)))



# -- A1 / A2 / G3 / A6 ---------------------------------------------------------------------
def _csv_roundtrip(spark, d):
    """Write the facts as CSV with a header into the shared folder, load them
    back with the schema check and type coercion."""
    import os
    import uuid

    from ledgerlens.session import checkpoint_dir

    path = os.path.join(checkpoint_dir(spark), "ledgerlens-stage", f"csv-{uuid.uuid4().hex}")
    facts(spark, d).select(*SPEC.fact_columns).write.option("header", True).csv(path)
    return SRC.load_raw(spark, path, fmt="csv")


register(
    "csv_roundtrip_facts", "A1 A2 A3",
    with_sales("""
SELECT Model, CAST(Year AS SMALLINT) AS Year, Region, Color, Fuel_Type, Transmission,
       CAST(Engine_Size_L AS FLOAT) AS Engine_Size_L, CAST(Mileage_KM AS INT) AS Mileage_KM,
       CAST(trunc(Price_USD) AS INT) AS Price_USD, CAST(Sales_Volume AS INT) AS Sales_Volume, Sales_Classification
FROM sales"""),
)(_csv_roundtrip)


def _schema_report(spark, d):
    """Columns and types of the landed tables against what the fact adapter reads."""
    rows = None
    for name, wanted in sorted(ADAPTER_COLUMNS.items()):
        landed = SRC.table(spark, d, name)
        have = dict(landed.dtypes)
        counts = landed.agg(*[F.count(c).alias(c) for c in wanted if c in have])
        found = counts.unpivot([], [c for c in wanted if c in have], "column_name", "n_present")
        found = found.select(F.lit(name).alias("table_name"), "column_name", "n_present", F.lit("present").alias("status"))
        missing = [(name, c, 0, "missing") for c in wanted if c not in have]
        if missing:
            found = found.unionByName(spark.createDataFrame(missing, found.schema))
        rows = found if rows is None else rows.unionByName(found)
    return rows


#: Columns that the fact adapter reads, by table.
ADAPTER_COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"),
    "customer": ("c_custkey", "c_nationkey", "c_mktsegment"),
    "nation": ("n_nationkey", "n_regionkey"), "region": ("r_regionkey", "r_name"),
    "part": ("p_partkey", "p_brand", "p_type", "p_size"),
}
register(
    "schema_check_report", "A2 G3",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT({c}) AS n_present, 'present' AS status FROM {t}"
        for t, cols in sorted(ADAPTER_COLUMNS.items()) for c in cols),
)(_schema_report)


def _cached_panel(spark, d):
    f = facts(spark, d)
    window = PN.year_window(f, SPEC)
    params = {"panel": "external_panel", "facts": facts_signature(spark, d), "start_year": window.start_year,
              "end_year": window.end_year}
    panel, _ = PL.cached_frame(spark, "external_panel", params,
                               lambda: PN.build_external_panel(f, SPEC, window)[0], built_tag="mock")
    return panel.select("region", "year", "inflation_pct", "gdp_per_capita_usd", "regulation_stringency_index",
                        "fleet_co2_target_g_km", "co2_emissions_pc", "currency", "usd_per_unit")


register("cached_external_panel", "A6",
         panel_sql("SELECT region, year, inflation_pct, gdp_per_capita_usd, regulation_stringency_index, "
                   "fleet_co2_target_g_km, co2_emissions_pc, currency, usd_per_unit FROM panel"))(_cached_panel)
