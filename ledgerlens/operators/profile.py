"""Slices, KPIs, profiles, histograms, reshaping and top-n (B1, B2, B16–B19,
D6–D16, F2, F5, G1–G3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.hashrand import hash_order
from ledgerlens.session import write_shared
from ledgerlens.spec import TableSpec


# -- B1 / B2 -------------------------------------------------------------------------
def slice_facts(df: DataFrame, spec: TableSpec, regions: Sequence[str], fuels: Sequence[str],
                year_lo: int, year_hi: int) -> DataFrame:
    """B1: region ∈ set AND fuel ∈ set AND year BETWEEN; an empty set selects nothing.

    Plain predicates, so they are pushed to the scan where the columns are stored.
    """
    return df.where(
        F.col(spec.region).isin(list(regions))
        & F.col(spec.fuel).isin(list(fuels))
        & F.col(spec.year).between(year_lo, year_hi)
    )


def filter_domains(df: DataFrame, spec: TableSpec) -> DataFrame:
    """B2: distinct regions and fuels, and the year range, as (kind, value) rows."""
    regions = df.select(F.lit("region").alias("kind"), F.col(spec.region).alias("value")).distinct()
    fuels = df.select(F.lit("fuel_type").alias("kind"), F.col(spec.fuel).alias("value")).distinct()
    years = df.agg(F.min(spec.year).alias("lo"), F.max(spec.year).alias("hi")).select(
        F.explode(F.array(
            F.struct(F.lit("year_min").alias("kind"), F.col("lo").cast("string").alias("value")),
            F.struct(F.lit("year_max").alias("kind"), F.col("hi").cast("string").alias("value")),
        )).alias("s")
    ).select("s.*")
    return regions.unionByName(fuels).unionByName(years).orderBy("kind", "value")


# -- D6 / D16 / B16 -------------------------------------------------------------------
def kpi_row(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows, mean price, total volume, electrified row share %, distinct models."""
    elec = F.col(spec.fuel).isin(list(spec.electrified_fuels)).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(F.col(spec.price).cast("double")), 6).alias("mean_price"),
        F.sum(spec.volume).cast("long").alias("total_volume"),
        F.round(F.avg(elec) * 100.0, 6).alias("electrified_share_pct"),
        F.count_distinct(spec.model).alias("n_models"),
    )


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 name: str = "metric", value: str = "value") -> DataFrame:
    """Wide -> long (``melt``); values cast to double."""
    cast = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return cast.unpivot(list(ids), list(values), name, value)


def pivot_wide(df: DataFrame, row: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long -> wide with a fixed list of names (no extra pass to find them)."""
    return df.groupBy(row).pivot(name, list(names)).agg(F.first(value))


# -- D7–D9 ----------------------------------------------------------------------------
def volume_by(df: DataFrame, spec: TableSpec, keys: Sequence[str], ascending: bool = True) -> DataFrame:
    """Σ volume by keys (lower-cased output names)."""
    out = df.groupBy(*[F.col(k).alias(k.lower()) for k in keys]).agg(
        F.sum(spec.volume).cast("long").alias("total_volume")
    )
    return out.orderBy(F.col("total_volume").asc() if ascending else F.col("total_volume").desc())


def mean_price_by_model(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Mean price per model, descending."""
    return df.groupBy(F.col(spec.model).alias("model")).agg(
        F.round(F.avg(F.col(spec.price).cast("double")), 6).alias("mean_price")
    ).orderBy(F.desc("mean_price"))


# -- D10 ------------------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram with at most ``bins`` bins; the last bin is closed.

    Two passes: a min/max aggregate (two scalars to the driver), then one
    grouped count on the bin index.
    """
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    width = hi - lo
    x = F.col(col).cast("double")
    if width > 0:
        b = F.least(F.floor((x - F.lit(lo)) / F.lit(width) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    else:
        b = F.lit(0)
    counted = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = width / bins if width > 0 else 0.0
    return counted.select(
        "bin",
        F.round(F.lit(lo) + F.col("bin") * F.lit(step), 6).alias("bin_lo"),
        F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(step), 6).alias("bin_hi"),
        "n",
    ).orderBy("bin")


# -- D11 ------------------------------------------------------------------------------
#: Most levels of the second column of a contingency table; the table has all of them in each row.
MAX_TABLE_COLUMNS = 100_000


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) with zero cells filled, long form.

    The facts meet one aggregate, whose cells are written. The levels of ``b``, the
    columns of the table, are listed (an error beyond ``MAX_TABLE_COLUMNS``); each level
    of ``a`` looks them up in a map of its own counts, so nothing is crossed by a join.
    """
    cells = write_shared(df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")), "cells")
    levels = [r["b"] for r in cells.where(F.col("b").isNotNull()).select("b").distinct().limit(MAX_TABLE_COLUMNS + 1).collect()]
    if len(levels) > MAX_TABLE_COLUMNS:
        raise ValueError(f"{b} has more than {MAX_TABLE_COLUMNS} levels")
    held = F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "n"))))
    rows = cells.groupBy("a").agg(held.alias("held"))
    kind = cells.schema["b"].dataType
    column = F.explode(F.array(*[F.lit(x).cast(kind) for x in levels]) if levels else F.array().cast(f"array<{kind.simpleString()}>"))
    return rows.select(F.col("a"), "held", column.alias("b")).select(
        F.col("a").alias(a.lower()), F.col("b").alias(b.lower()), F.coalesce(F.try_element_at("held", "b"), F.lit(0)).cast("long").alias("n"))


# -- D12–D14 --------------------------------------------------------------------------
def null_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls (and NaN for floating columns) per column plus the total, long form."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)

    def isnull(c):
        cond = F.col(c).isNull()
        if types[c] in ("double", "float"):
            cond = cond | F.isnan(F.col(c))
        return F.sum(cond.cast("long"))

    wide = df.agg(*[isnull(c).alias(c) for c in columns])
    wide = wide.withColumn("__total__", sum((F.col(c) for c in columns), F.lit(0)).cast("long"))
    return wide.unpivot([], [*columns, "__total__"], "column_name", "n_null")


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each identical group (nulls compare equal)."""
    columns = list(columns or df.columns)
    grouped = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("cnt"))
    return grouped.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


# -- D15 ------------------------------------------------------------------------------
def numeric_profile(df: DataFrame, columns: Sequence[str], *, approx_distinct: bool = False) -> DataFrame:
    """D15 (numeric): count, distinct, mean, sample std, min, max per column.

    Exact distinct counts expand the input once per column; on very large
    tables ``approx_distinct=True`` uses HyperLogLog++ sketches instead (one
    pass, partial aggregation, ~1% relative error).
    """
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        distinct = F.approx_count_distinct(x) if approx_distinct else F.count_distinct(x)
        aggs += [
            F.count(x).alias(f"{c}__count"), distinct.alias(f"{c}__unique"),
            F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
        ]
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__count").alias("count"), F.col(f"{c}__unique").alias("n_unique"),
            F.round(F.col(f"{c}__mean"), 6).alias("mean"), F.round(F.col(f"{c}__std"), 6).alias("std"),
            F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
        ) for c in columns
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D15 (categorical): count, distinct, most frequent value (ties: smallest) and its count.

    One pass: columns are stacked to (column, value), counted per value, then
    reduced per column with ``min_by`` — no window, no per-column job.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("s")).select("s.*")
    per_value = stacked.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return per_value.groupBy("column_name").agg(
        F.sum("cnt").cast("long").alias("count"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top"),
        F.max("cnt").cast("long").alias("freq"),
    )


# -- B18 / B19 / F2 / F5 -------------------------------------------------------------
def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, reproducible: top-n by md5(key:seed).

    A distributed top-n (TakeOrderedAndProject): each task keeps n candidates.
    """
    return df.orderBy(hash_order(F.col(key), seed)).limit(n)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """First n rows in key order (Spark rows have no order without a key)."""
    return df.orderBy(key).limit(n)


def top_n(df: DataFrame, order_col: str, n: int, descending: bool = True) -> DataFrame:
    """top-n rows by one column."""
    return df.orderBy(F.col(order_col).desc() if descending else F.col(order_col).asc()).limit(n)


def argmax_by_group(df: DataFrame, group: str, item: str, metric: str) -> DataFrame:
    """per group, the item with the largest metric (ties: smallest item)."""
    return df.groupBy(group).agg(
        F.min_by(item, F.struct(-F.col(metric), F.col(item))).alias(f"best_{item}"),
        F.max(metric).alias(f"best_{metric}"),
    )


def column_difference(have: Sequence[str], want: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names."""
    return sorted(set(want) - set(have)), sorted(set(have) - set(want))
