"""Landed JSON payloads (A7, A8) and the keyed Parquet cache.

Payload text is parsed with ``from_json`` / ``get_json_object`` on the
executors; malformed payloads go to a reject frame instead of failing the job.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.panel import PanelWindow, spine
from ledgerlens.session import checkpoint_dir
from ledgerlens.spec import TableSpec

OBS_SCHEMA = "array<struct<date:string,value:string>>"


def indicator_payloads(facts: DataFrame, spec: TableSpec, window: PanelWindow) -> DataFrame:
    """Indicator envelopes ``[meta, [{date, value}, ...]]`` built from the facts.

    One envelope per (region, fuel): yearly total volume over every year of the
    window, ``null`` where a year has no sales (as indicator APIs report gaps).
    Each envelope lists at most the years of the window.
    """
    keys = facts.select(F.col(spec.region).alias("region"), F.col(spec.fuel).alias("fuel_type"))
    yearly = facts.groupBy(
        F.col(spec.region).alias("region"), F.col(spec.fuel).alias("fuel_type"), F.col(spec.year).alias("year")
    ).agg(F.sum(spec.volume).cast("double").alias("value"))
    full = spine(keys, window).join(yearly, ["region", "fuel_type", "year"], "left")
    obs = F.to_json(F.collect_list(F.struct(F.col("year").cast("string").alias("date"), F.col("value"))))
    return full.groupBy("region", "fuel_type").agg(
        F.concat(F.lit('[{"page":1,"per_page":500},'), obs, F.lit("]")).alias("raw")
    )


def parse_indicator_payloads(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(observations, rejects). Observations are (…keys, year, value).

    A null value is a gap and yields nothing; anything else that yields no
    observation is a reject with its text and a reason, be it a whole payload or
    one observation of a good one.
    """
    keys = [c for c in df.columns if c != raw]
    env = F.from_json(F.col(raw), "array<string>")
    second = F.get("_env", F.lit(1))
    checked = df.withColumn("_env", env).withColumn("_list", F.from_json(second, OBS_SCHEMA)).withColumn(
        "_reason",
        F.when(~F.coalesce(F.ltrim(F.col(raw)).startswith("["), F.lit(False)) | F.col("_env").isNull(), F.lit("not a JSON array"))
        .when(F.size("_env") < 2, F.lit("envelope shorter than 2"))
        .when(second.isNull(), F.lit("null observation list"))
        .when(~F.ltrim(second).startswith("[") | F.col("_list").isNull(), F.lit("observation list is not an array")),
    )
    obs = checked.where(F.col("_reason").isNull()).select(*keys, F.explode("_list").alias("o"))
    year, value = F.expr("try_cast(o.date AS INT)"), F.expr("try_cast(o.value AS DOUBLE)")
    obs = obs.withColumns({"year": year, "value": value}).withColumn(
        "_reason",
        F.when(F.col("o").isNull(), F.lit("observation is not an object"))
        .when(F.col("o.value").isNull(), F.lit(None))
        .when(F.col("value").isNull(), F.lit("value is not a number"))
        .when(F.col("year").isNull(), F.lit("date is not a year")),
    )
    parsed = obs.where(F.col("_reason").isNull() & F.col("value").isNotNull()).select(*keys, "year", "value")
    rejects = checked.where(F.col("_reason").isNotNull()).select(*keys, raw, F.col("_reason").alias("reason")).unionByName(
        obs.where(F.col("_reason").isNotNull()).select(*keys, F.to_json("o").alias(raw), F.col("_reason").alias("reason")))
    return parsed, rejects


def fx_payloads(fx: DataFrame) -> DataFrame:
    """FX payload text ``{"rates": {"USD": x}}`` per (region, year)."""
    return fx.select(
        "region", "year",
        F.to_json(F.struct(F.struct(F.col("usd_per_unit").alias("USD")).alias("rates"))).alias("raw"),
    )


def parse_fx_payloads(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """``rates.USD`` as double; a payload without it, or with text for it, is rejected."""
    keys = [c for c in df.columns if c != raw]
    rate = F.get_json_object(F.col(raw), "$.rates.USD").try_cast("double")
    tagged = df.withColumn("usd_per_unit", rate)
    parsed = tagged.where(F.col("usd_per_unit").isNotNull()).select(*keys, "usd_per_unit")
    rejects = tagged.where(F.col("usd_per_unit").isNull()).select(
        *keys, raw, F.lit("FX rate missing").alias("reason")
    )
    return parsed, rejects


def json_field(df: DataFrame, raw: str, path: str, out: str, dtype: str = "double") -> DataFrame:
    """A8 on any JSON text column (e.g. ``events.props`` ``$.k``); what doesn't cast is NULL."""
    return df.withColumn(out, F.get_json_object(F.col(raw), path).try_cast(dtype))


# -- A6 keyed cache ---------------------------------------------------------------
def cache_key(name: str, params: dict) -> str:
    payload = json.dumps(params, sort_keys=True, default=str)
    return f"{name}_{hashlib.sha1(payload.encode('utf-8')).hexdigest()[:16]}"


def cached_frame(
    spark: SparkSession,
    name: str,
    params: dict,
    build: Callable[[], DataFrame],
    *,
    built_tag: str = "live",
    cache_root: str | None = None,
    partition_by: str | None = None,
) -> tuple[DataFrame, str]:
    """Read a cached panel by parameter key, else build, write and tag it.

    ``params`` must hold whatever the panel depends on, its source's signature
    included. Each build is written to a path of its own and published by a one-row
    table that names it, so a half-written or overwritten panel is never read; an
    entry that can't be read is rebuilt. Returns (frame, provenance): ``cache``, or
    ``built_tag``, which says what the builder's rows are.
    """
    root = cache_root or f"{checkpoint_dir(spark)}/ledgerlens-cache"
    entry = f"{root}/{name}/{cache_key(name, params)}"
    try:
        path = spark.read.schema("path string").parquet(f"{entry}/published").first()["path"]
        cached = spark.read.parquet(path)
        cached.limit(1).collect()
        return cached, "cache"
    except Exception:  # noqa: BLE001 — a missing or corrupt entry falls back to a build
        pass
    path = f"{entry}/{uuid.uuid4().hex}"
    writer = build().write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{entry}/published")
    return spark.read.parquet(path), built_tag
