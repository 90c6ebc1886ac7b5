"""Oracle SQL building blocks (plain SQL that DuckDB runs on the base tables).

Only the base tables are registered in the oracle engine, so every oracle starts
with the ``sales`` CTE below: the same projection the Spark adapter
(:func:`ledgerlens.sources.facts.sales_facts`) builds with the DataFrame API.
"""

from __future__ import annotations

from ledgerlens.spec import TPCH_SPEC

SPEC = TPCH_SPEC


def _in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ELECTRIFIED_SQL = _in_list(SPEC.electrified_fuels)
PREMIUM_SQL = _in_list(SPEC.premium_models)

SALES_BODY = f"""
  SELECT p.p_brand AS Model,
         CAST(year(o.o_orderdate) AS INT) AS Year,
         r.r_name AS Region,
         p.p_type AS Color,
         c.c_mktsegment AS Fuel_Type,
         l.l_linestatus AS Transmission,
         CAST(p.p_size AS DOUBLE) / 10 AS Engine_Size_L,
         CAST(floor(o.o_totalprice) AS INT) AS Mileage_KM,
         l.l_extendedprice AS Price_USD,
         CAST(l.l_quantity AS INT) AS Sales_Volume,
         CASE WHEN l.l_quantity >= {SPEC.leak_threshold} THEN 'High' ELSE 'Low' END AS Sales_Classification,
         md5(concat_ws(':', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_partkey AS VARCHAR),
                       CAST(l.l_suppkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
                       CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS VARCHAR))) AS row_key
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
"""

FEATURES_BODY = f"""
  SELECT *,
         greatest({SPEC.reference_year} - Year, 0) AS vehicle_age,
         CAST(Mileage_KM AS DOUBLE) / CASE WHEN greatest({SPEC.reference_year} - Year, 0) = 0 THEN 1
                                      ELSE greatest({SPEC.reference_year} - Year, 0) END AS mileage_per_year,
         CASE WHEN Engine_Size_L = 0 THEN NULL ELSE Price_USD / Engine_Size_L END AS price_per_litre_engine,
         ln(Price_USD) AS log_price,
         ln(1 + CAST(Mileage_KM AS DOUBLE)) AS log_mileage,
         CASE WHEN Fuel_Type IN ({ELECTRIFIED_SQL}) THEN 1 ELSE 0 END AS is_electrified,
         CASE WHEN Model IN ({PREMIUM_SQL}) THEN 1 ELSE 0 END AS is_premium_tier
  FROM sales
"""


def with_sales(body: str, *, features: bool = False, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the ``sales`` (and optionally ``feat``) CTEs."""
    ctes = f"sales AS ({SALES_BODY})"
    if features:
        ctes += f",\nfeat AS ({FEATURES_BODY})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def hash_uniform_sql(text_expr: str) -> str:
    """DuckDB twin of :func:`ledgerlens.functions.hashrand.hash_uniform`."""
    return f"((CAST(('0x' || substr(md5({text_expr}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def hash_normal_sql(text_expr: str) -> str:
    """DuckDB twin of :func:`ledgerlens.functions.hashrand.hash_normal`."""
    u1 = hash_uniform_sql(f"({text_expr}) || ':a'")
    u2 = hash_uniform_sql(f"({text_expr}) || ':b'")
    return f"(sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}))"


def dbl(x) -> str:
    """A DOUBLE literal (plain decimals would be DECIMAL in the oracle engine)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def case_map(expr: str, mapping: dict, default) -> str:
    """CASE lookup of a literal map; numbers become DOUBLE literals."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return dbl(v)
        return "'" + str(v).replace("'", "''") + "'"

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {lit(default)} END)"
