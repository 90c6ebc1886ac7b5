"""Fact-table sources: CSV/Parquet loading with schema checks (A1–A4) and the
adapter that projects the TPC-H-like test tables into the canonical facts.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerlens.spec import FACT_COLUMNS, FACT_DDL, TPCH_SPEC, TableSpec

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Dimension tables whose size is fixed by the TPC-H definition (5 regions, 25
# nations). They are broadcast only after a row-count check against this bound.
_DIM_ROW_BOUND = 10_000


class SchemaValidationError(ValueError):
    """Missing or unexpected columns in a fact source."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def broadcast_if_bounded(df: DataFrame, max_rows: int = _DIM_ROW_BOUND) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven under ``max_rows``.

    Beyond the bound the frame is returned as is and the planner (with AQE's
    runtime size check) picks the join strategy.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


# -- A2 schema check ----------------------------------------------------------
def check_columns(columns: list[str], expected: tuple[str, ...] = FACT_COLUMNS) -> None:
    """Raise :class:`SchemaValidationError` on missing or unexpected columns."""
    have, want = set(columns), set(expected)
    missing, extra = sorted(want - have), sorted(have - want)
    if missing or extra:
        raise SchemaValidationError(f"missing columns {missing}; unexpected columns {extra}")


# -- A3 type coercion -----------------------------------------------------------
_INTEGRAL = ("TINYINT", "SMALLINT", "INT", "BIGINT")


def coerce_types(df: DataFrame, ddl: str = FACT_DDL) -> DataFrame:
    """Cast each canonical column to its declared type, keeping column order.

    Text headed for an integer type goes through an exact decimal, so "901.0"
    becomes 901 and no digit of a long integer is lost; a fraction is cut off and
    non-numeric text still fails the ANSI cast.
    """
    types = dict(part.strip().split(" ", 1) for part in ddl.split(","))
    dtypes = dict(df.dtypes)

    def cast(c):
        t = types[c]
        if t.upper() in _INTEGRAL and dtypes[c] == "string":
            return F.col(c).cast("decimal(38,9)").cast(t)
        return F.col(c).cast(t)

    return df.select(*[cast(c).alias(c) if c in types else F.col(c) for c in df.columns])


# -- A1 load ------------------------------------------------------------------
def load_raw(
    spark: SparkSession,
    path: str,
    *,
    validate: bool = True,
    apply_dtypes: bool = True,
    fmt: str | None = None,
) -> DataFrame:
    """Load a fact table from CSV (header) or Parquet.

    The header is read first without a schema, so a wrong header is caught by the
    column check instead of being hidden by a supplied schema. Unless ``fmt`` says
    otherwise, names that end in .csv (or .csv.gz, .txt) are CSV and all others Parquet.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz", ".txt")) else "parquet")
    try:
        if fmt == "csv":
            df = spark.read.option("header", True).csv(path)
        else:
            df = spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(path) from exc
        raise
    if validate:
        check_columns(df.columns)
    if apply_dtypes:
        df = coerce_types(df)
    return df


# -- A4 type-inferred view ------------------------------------------------------
def register_view(spark: SparkSession, path: str, name: str = "sales", *, fmt: str | None = None) -> DataFrame:
    """Register a type-inferred CSV (or Parquet) view for ad-hoc SQL; ``fmt`` says which where the path's name doesn't."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz", ".txt")) else "parquet")
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


# -- TPC-H adapter ----------------------------------------------------------------
def row_key(l_orderkey: Column, l_partkey: Column, l_suppkey: Column, l_linenumber: Column,
            l_extendedprice: Column) -> Column:
    cents = F.round(l_extendedprice * 100).cast("bigint")
    parts = [c.cast("string") for c in (l_orderkey, l_partkey, l_suppkey, l_linenumber, cents)]
    return F.md5(F.concat_ws(":", *parts))


def sales_facts(spark: SparkSession, sf_dir: str, spec: TableSpec = TPCH_SPEC) -> DataFrame:
    """Project lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part into facts.

    Only the columns the facts need are read (Parquet column pruning). nation and
    region are bounded dimensions and are broadcast after a size check; the big
    joins are shuffled on their keys (AQE broadcasts a side whose runtime size is
    under the broadcast threshold and splits skewed key partitions).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_linestatus",
    )
    # the year and the whole price only: fractions and days would be shuffled with every line
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.floor("o_totalprice").alias("o_total"), F.year("o_orderdate").cast("int").alias("o_year"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")

    geo = broadcast_if_bounded(
        nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    )
    cust_geo = cust.join(geo, cust.c_nationkey == geo.n_nationkey)
    # Join order matters at scale (no cost-based reordering without table
    # statistics): resolve the customer side on orders first, so the
    # lineitem-sized rows are shuffled twice (order key, then part key) and
    # never a third time on the customer key.
    orders_c = orders.join(cust_geo, orders.o_custkey == cust_geo.c_custkey)
    joined = (
        li.join(orders_c, li.l_orderkey == orders_c.o_orderkey)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    high = F.col("l_quantity") >= F.lit(spec.leak_threshold)
    return joined.select(
        F.col("p_brand").alias(spec.model),
        F.col("o_year").alias(spec.year),
        F.col("r_name").alias(spec.region),
        F.col("p_type").alias(spec.color),
        F.col("c_mktsegment").alias(spec.fuel),
        F.col("l_linestatus").alias(spec.transmission),
        (F.col("p_size").cast("double") / 10).alias(spec.engine),
        F.col("o_total").cast("int").alias(spec.mileage),
        F.col("l_extendedprice").alias(spec.price),
        F.col("l_quantity").cast("int").alias(spec.volume),
        F.when(high, F.lit(spec.positive_label)).otherwise(F.lit(spec.negative_label)).alias(spec.label),
        row_key(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"),
                F.col("l_linenumber"), F.col("l_extendedprice")).alias(spec.key),
    )
