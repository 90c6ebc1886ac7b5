"""Sinks: metrics tables, model artefacts, run log, report tables.

Everything is written by Spark writers into a shared folder (by default under
the cluster's checkpoint folder), so a lost executor only re-runs its tasks.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerlens.session import checkpoint_dir


def default_root(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "ledgerlens-out", name)


# -- A12 / A13 metrics -------------------------------------------------------------------
def nested_metrics(metrics: DataFrame) -> DataFrame:
    """One JSON document per task: {"task": {"model": {"metric": value}}}."""
    per_model = metrics.groupBy("task", "model").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    per_task = per_model.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("mm"))
    return per_task.select("task", F.to_json(F.create_map(F.col("task"), F.col("mm"))).alias("json"))


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> str:
    """Write the long metrics table (task, model, metric, value)."""
    metrics.write.mode("overwrite").format(fmt).save(path)
    return path


def read_metrics(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read a metrics table back with its declared schema."""
    return spark.read.format(fmt).schema("task string, model string, metric string, value double").load(path)


# -- A14 model artefacts --------------------------------------------------------------------
def save_model(model: PipelineModel, path: str, features: list[str]) -> None:
    """Persist a fitted pipeline plus the feature list it was trained on."""
    model.write().overwrite().save(os.path.join(path, "model"))
    save_features(SparkSession.getActiveSession(), path, features)


def save_features(spark: SparkSession, path: str, features: Sequence[str]) -> None:
    """The feature list that goes with a saved model."""
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string") \
        .write.mode("overwrite").parquet(os.path.join(path, "features"))


def saved_features(spark: SparkSession, path: str) -> list[str] | None:
    """The feature list of a saved model; None where none was saved. Other read errors are raised."""
    try:
        return [r.feature for r in spark.read.parquet(os.path.join(path, "features")).orderBy("position").collect()]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load_model_if_compatible(spark: SparkSession, path: str, features: list[str]) -> PipelineModel | None:
    """Reuse a saved model only when its feature names equal ``features``."""
    if saved_features(spark, path) != list(features):
        return None
    return PipelineModel.load(os.path.join(path, "model"))


# -- A15 run log --------------------------------------------------------------------------
def log_run(spark: SparkSession, path: str, *, model: str, task: str, params: Mapping, metrics: Mapping,
            group: str = "default") -> str:
    """Append one row per param and metric of a run to a Parquet run table."""
    run_id = uuid.uuid4().hex
    ts = time.time()
    rows = [(run_id, ts, group, model, task, "param", k, json.dumps(v, default=str), None) for k, v in params.items()]
    rows += [(run_id, ts, group, model, task, "metric", k, None, float(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run_id string, ts double, run_group string, model string, task string, "
                                "kind string, name string, text_value string, value double") \
        .write.mode("append").parquet(path)
    return run_id


# -- A16 report tables ----------------------------------------------------------------------
def write_report_tables(frames: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """Each report section is a DataFrame, written as its own table."""
    paths = {}
    for name, df in frames.items():
        p = os.path.join(out_dir, name)
        df.write.mode("overwrite").format(fmt).save(p)
        paths[name] = p
    return paths
