"""Learners over one written, encoded training table.

The encoders are fitted once, on rows that are training rows of both tasks; the numbers
and category indices of every row are then written beside both labels, both splits and a
fold id, so that no fit or score runs the joins or hashes again. The vectors of linear
models follow from them row by row and are made by the fits that read them.

- Tree families: the rows are dealt by a hash of the key into shards of about
  ``SHARD_ROWS`` rows, packed one to a row; from ``FEW_MEMBERS`` shards on these grow to
  ``WIDE_SHARD_ROWS`` rows before there are more, as every row is scored by each member.
  Each (parameters, fold, shard) is a fit of its own in a task
  (:mod:`ledgerlens.operators.trees`); a model is the committee of its shards' fits. So a
  whole random search is one Spark job without a shuffle per tree, and its tasks are as
  large as a shard. A committee has at most ``MAX_MEMBERS`` members: beyond
  ``MAX_MEMBERS * WIDE_SHARD_ROWS`` rows its shards grow again, so that every training
  row is fitted at any size.
- Linear families are Spark ML estimators on one-hot columns and z-scores, their fits
  run in a bounded pool of jobs. A search of the least-squares family fits each draw and
  fold on as few rows as there are columns, which have the moments of all of the fold's.

Each model is saved with its feature list and logged as a run.
"""

from __future__ import annotations

import os
import random
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.hashrand import hash_order, hash_rank_key, hash_uniform
from ledgerlens.operators.features import add_engineered_features, select_features
from ledgerlens.operators.learn import (
    AUDIT_ROUNDS, LEAVES_DEPTH, RATE, ROUNDS, TREES, assign_split, classification_metrics, random_params, regression_metrics,
)
from ledgerlens.operators.ranks import cumulative_counts, order_statistics
from ledgerlens.operators.trees import Scorer, fit_trees
from ledgerlens.session import checkpoint_dir, drop_shared, write_shared
from ledgerlens.sources.sinks import log_run, save_features, save_model
from ledgerlens.spec import CONTROL_R2, SEED, TableSpec

#: Rows of a shard, shards from which on these grow to so many rows first, and shards from which on they grow without end.
SHARD_ROWS, FEW_MEMBERS, WIDE_SHARD_ROWS, MAX_MEMBERS = 50_000, 8, 400_000, 64
FOLDS, DRAWS, POOL = 3, 6, 4
FOREST_DEPTH = 8
TASKS = ("regression", "classification", "classification_leaked")
TREE_FAMILIES = ("Boosted", "Forest")
FAMILIES = {"regression": (*TREE_FAMILIES, "Linear"), "classification": (*TREE_FAMILIES, "Logistic"), "classification_leaked": (*TREE_FAMILIES, "Logistic")}
MEMBER_SCHEMA = (
    "job int, member int, n_rows long, start double, rate double, depth int, logistic boolean, edges array<array<double>>, ranks array<array<int>>, "
    "column binary, cut binary, value binary")
#: Members of a model that a scoring task receives in its closure, at most (a model is some megabytes).
MEMBER_FIELDS = ("start", "rate", "depth", "logistic", "edges", "ranks", "column", "cut", "value")


@dataclass
class TrainingTable:
    """The written table, and what was fitted to make it."""

    rows: DataFrame
    encoder: PipelineModel
    numeric: list[str]
    categorical: list[str]
    leaked: str
    n_rows: int
    shards: dict = field(default_factory=dict)

    def features(self, task: str) -> list[str]:
        return [*self.numeric, *self.categorical, *([self.leaked] if task.endswith("leaked") else [])]

    def n_numeric(self, task: str) -> int:
        return len(self.numeric) + task.endswith("leaked")

    def columns(self, task: str) -> list[str]:
        """Features in the order of the ``x`` array: numbers first."""
        return [*self.numeric, *([self.leaked] if task.endswith("leaked") else []), *self.categorical]

    def linear(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the encoder's vectors for linear models, which are computed where they are read and not stored."""
        held = [("numbers", i, c) for i, c in enumerate(self.numeric)] + [("indices", i, f"{c}__index") for i, c in enumerate(self.categorical)]
        out = rows.withColumns({c: F.col(array)[i] for array, i, c in held})
        for stage in self.encoder.stages[1:]:  # the first stage gave the indices
            out = stage.transform(out)
        return out

    def part(self, task: str, name: str | Sequence[str]) -> DataFrame:
        """Rows of a split: key, label, ``x`` (for trees), ``linear`` (for linear models), fold."""
        kind = "reg" if task == "regression" else "clf"
        names = [name] if isinstance(name, str) else list(name)
        x = F.concat("numbers", F.array("label_reg") if task.endswith("leaked") else F.array().cast("array<double>"), "indices")
        linear = F.col("linear_leaked" if task.endswith("leaked") else "linear")
        return self.linear(self.rows.where(F.col(f"split_{kind}").isin(names))).select("row_key", F.col(f"label_{kind}").alias("label"), x.alias("x"), linear.alias("linear"), "fold")


def training_table(df: DataFrame, spec: TableSpec, *, target: str | None = None, seed: int = SEED, folds: int = FOLDS) -> TrainingTable:
    """Encode ``df`` once for all tasks and write it; ``target`` replaces the volume as the number to predict."""
    data = add_engineered_features(df, spec)
    numeric, categorical = select_features(data, spec)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    frame = data.select(
        F.col(spec.key).alias("row_key"), *[number(c) for c in numeric], *[text(c) for c in categorical],
        F.col(target or spec.volume).cast("double").alias("label_reg"), (F.col(spec.label) == spec.positive_label).cast("double").alias("label_clf"),
        F.least(F.floor(hash_uniform(F.col(spec.key), seed, "fold") * folds), F.lit(folds - 1)).cast("int").alias("fold"),
        hash_rank_key(F.col(spec.key), seed).alias("_rank"))
    frame = write_shared(frame.where("label_reg is not null and label_clf is not null"), "learn-frame")
    split = assign_split(assign_split(frame, "row_key", rank="_rank").withColumnRenamed("split", "split_reg"), "row_key", rank="_rank", stratify="label_clf")
    split = split.withColumnRenamed("split", "split_clf")
    index = [f"{c}__index" for c in categorical]
    encoder = Pipeline(stages=[
        StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=[f"{c}__hot" for c in categorical], handleInvalid="keep"),
        VectorAssembler(inputCols=numeric, outputCol="__numbers"),
        StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["__scaled", *[f"{c}__hot" for c in categorical]], outputCol="linear"),
        # the label's own source, which only the leakage demonstration may see
        VectorAssembler(inputCols=["linear", "label_reg"], outputCol="linear_leaked"),
    ]).fit(split.where("split_reg = 'train' and split_clf = 'train'"))
    # a column for each feature: those of few values, as a panel's, take a few bits a row
    held = ["row_key", "label_reg", "label_clf", "split_reg", "split_clf", "fold"]
    stored = write_shared(encoder.transform(split).select(*held, *numeric, *index), "learn-table")
    rows = stored.select(*held, F.array(*numeric).alias("numbers"), F.array(*index).alias("indices"))
    n_rows = frame.count()
    drop_shared(frame)
    return TrainingTable(rows, encoder, numeric, categorical, spec.volume, n_rows)


# -- tree families -----------------------------------------------------------------------
def packed_shards(table: TrainingTable, task: str, part: DataFrame | None = None, name: str = "train") -> DataFrame:
    """(shard, n, width, x, y, fold): the training rows, a bounded shard to a row, written once per task."""
    if (task, name) in table.shards:
        return table.shards[task, name]
    n_shards = max(1, min(-(-table.n_rows // SHARD_ROWS), FEW_MEMBERS), min(-(-table.n_rows // WIDE_SHARD_ROWS), MAX_MEMBERS))
    rows = (table.part(task, "train") if part is None else part).withColumn("shard", F.pmod(F.xxhash64("row_key"), F.lit(n_shards)).cast("int"))
    rows = rows.select("shard", "row_key", "x", F.col("label").alias("y"), "fold")

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("row_key")
        n = part.num_rows
        x = np.ascontiguousarray(part["x"].combine_chunks().flatten().to_numpy().reshape(n, -1).T, "<f8")  # by column: those of few values pack well
        return pa.table({
            "shard": pa.array([part["shard"][0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "width": pa.array([len(x)], pa.int32()),
            "x": pa.array([pa.Codec("zstd", 1).compress(x, asbytes=True)], pa.binary()),
            "y": pa.array([part["y"].to_numpy().astype("<f8").tobytes()], pa.binary()), "fold": pa.array([part["fold"].to_numpy().astype("i1").tobytes()], pa.binary())})

    table.shards[task, name] = write_shared(rows.groupBy("shard").applyInArrow(pack, "shard int, n long, width int, x binary, y binary, fold binary"), "shards")
    return table.shards[task, name]


def fit_committees(shards: DataFrame, jobs: Sequence[tuple[dict, int | None]], task: str, n_numeric: int, *, seed: int = SEED) -> DataFrame:
    """Members (a row each) of every job's committee; a job is (parameters, fold left out or None)."""
    listed = list(jobs)
    n_tasks = max(1, shards.count() * len(listed))
    # a range for each (job, shard), so that no task gets several while others get none
    spread = shards.withColumn("job", F.explode(F.array(*[F.lit(i) for i in range(len(listed))]))).repartitionByRange(n_tasks, "job", "shard")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                params, left_out = listed[row.job]
                y = np.frombuffer(row.y, "<f8")
                x = np.frombuffer(pa.Codec("zstd").decompress(row.x, decompressed_size=8 * row.n * row.width, asbytes=True), "<f8").reshape(row.width, row.n).T
                kept = np.frombuffer(row.fold, "i1") != (-1 if left_out is None else left_out)
                if not kept.any():
                    continue
                member = fit_trees(x[kept], y[kept], n_numeric, task=task, seed=seed * 1_000_003 + row.job * 1009 + row.shard, **params)
                yield pd.DataFrame([{"job": row.job, "member": row.shard, "n_rows": int(kept.sum()), **member}])

    return write_shared(spread.mapInPandas(fit, MEMBER_SCHEMA), "members")


class Committee:
    """A fitted tree model: at most ``MAX_MEMBERS`` members, each the mean of all weighs by its rows."""

    def __init__(self, members: list[dict]) -> None:
        self.members = sorted(members, key=lambda m: m["member"])

    @classmethod
    def of(cls, members: DataFrame, job: int) -> Committee:
        return cls([r.asDict() for r in members.where(F.col("job") == job).collect()])

    def predictor(self):
        members = [{k: m[k] for k in MEMBER_FIELDS} for m in self.members]
        weights = np.array([m["n_rows"] for m in self.members], "f8")
        ready: list[Scorer] = []  # filled where the predictor runs

        def predict(x: np.ndarray) -> np.ndarray:
            if not ready:
                ready.extend(map(Scorer, members))
            return np.average([score(x) for score in ready], axis=0, weights=weights)

        splits = np.concatenate([np.zeros(0, "<i2"), *(np.frombuffer(m["column"], "<i2") for m in members)])
        predict.used = np.unique(splits[splits >= 0]).tolist()  # columns that a tree splits on
        return predict

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (row_key, label, x, …) as (row_key, label, fold, score)."""
        predict = self.predictor()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"row_key": pdf["row_key"], "label": pdf["label"], "fold": pdf["fold"], "score": predict(np.stack(pdf["x"].to_numpy()))})

        return rows.select("row_key", "label", "fold", "x").mapInPandas(run, "row_key string, label double, fold int, score double")

    def save(self, spark: SparkSession, path: str, features: Sequence[str]) -> None:
        spark.createDataFrame([tuple(m[f.split()[0]] for f in MEMBER_SCHEMA.split(", ")) for m in self.members], MEMBER_SCHEMA).write.mode("overwrite").parquet(os.path.join(path, "model"))
        save_features(spark, path, features)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Committee:
        return cls([r.asDict() for r in spark.read.parquet(os.path.join(path, "model")).collect()])


def tree_params(name: str, rounds: int, trees: int) -> dict:
    """The fixed sizes of a tree family."""
    if name == "Boosted":
        return {"kind": "boosted", "rounds": rounds, "depth": LEAVES_DEPTH, "rate": RATE}
    return {"kind": "forest", "rounds": trees, "depth": FOREST_DEPTH}


def tree_draws(name: str, draws: int, seed: int, rounds: int, trees: int) -> list[dict]:
    """K5: parameter maps drawn at random around the fixed sizes."""
    rng = random.Random(f"{name}:{seed}")
    out = []
    for _ in range(draws):
        params = {**tree_params(name, rounds, trees), "subsample": rng.uniform(0.6, 1.0), "min_rows": float(rng.randint(1, 50))}
        if name == "Boosted":
            params |= {"depth": rng.randint(3, 6), "rate": math.exp(rng.uniform(math.log(0.01), math.log(0.2)))}
        else:
            params |= {"depth": rng.randint(4, 9)}
        out.append(params)
    return out


# -- linear families ---------------------------------------------------------------------
def linear_estimator(task: str):
    columns = {"featuresCol": "linear", "labelCol": "label"}
    return LinearRegression(**columns) if task == "regression" else LogisticRegression(**columns, maxIter=100)


def linear_score(model, rows: DataFrame, task: str) -> DataFrame:
    out = model.transform(rows)
    return out.select("row_key", "label", "fold", (F.col("prediction") if task == "regression" else vector_to_array("probability")[1]).alias("score"))


# -- scores, search, benchmark --------------------------------------------------------------
def _primary(task: str) -> str:
    return "r2" if task == "regression" else "roc_auc"


def metrics_of(scored: DataFrame, task: str, by: Sequence[str] = ()) -> DataFrame:
    return regression_metrics(scored, "label", "score", by) if task == "regression" else classification_metrics(scored, "label", "score", by)


def _fold_scores(scored: DataFrame, task: str) -> list[float]:
    """The primary metric of one row's worth of scores; undefined ones count as the worst."""
    value = metrics_of(scored, task).first()[_primary(task)]
    return float("-inf") if value is None else float(value)


def _held_out(rows: DataFrame, column: str, models) -> DataFrame:
    """(job, label, score) of every row by each of ``models(fold)``, the functions (by job) that didn't see its fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x = np.stack(part[column].to_numpy())
                for job, predict in models(int(fold)).items():
                    yield pd.DataFrame({"job": job, "label": part["label"], "score": predict(x)})

    return rows.select("fold", "label", column).mapInPandas(run, "job int, label double, score double")


def search_trees(table: TrainingTable, task: str, name: str, *, draws: int = DRAWS, folds: int = FOLDS, seed: int = SEED, rounds: int = ROUNDS, trees: int = TREES) -> tuple[dict, list[tuple]]:
    """K5: every draw fitted without every fold, in one job; all scores from one pass over the rows.

    Returns the best parameters by the mean fold score, and (draw, fold, value) of all.
    """
    maps = tree_draws(name, draws, seed, rounds, trees)
    jobs = [(m, f) for m in maps for f in range(folds)]
    members = fit_committees(packed_shards(table, task), jobs, task, table.n_numeric(task), seed=seed)
    scored = None
    for d in range(draws):  # a draw at a time: deep trees of all draws are too large for a task
        fitted = [Committee.of(members, d * folds + f).predictor() for f in range(folds)]
        part = write_shared(_held_out(table.part(task, "train").select("fold", "label", "x"), "x", lambda fold, fitted=fitted, d=d: {d * folds + fold: fitted[fold]} if fold < folds else {}), "search-scores")
        scored = part if scored is None else scored.unionByName(part)
    found = {r["job"]: r[_primary(task)] for r in metrics_of(scored, task, ["job"]).collect()}
    rows = [(i // folds, i % folds, float("-inf") if found.get(i) is None else float(found[i])) for i in range(len(jobs))]
    return maps[best_draw(rows)], rows


def search_linear(table: TrainingTable, task: str, name: str, *, draws: int = DRAWS, folds: int = FOLDS, seed: int = SEED) -> tuple[dict, list[tuple]]:
    """K5 for a Spark ML family: a fit for each draw and fold, in a bounded pool of jobs.

    Least squares and their scores depend on the folds' moments alone, which one pass
    over the rows finds. Other families are fitted on the rows; one pass scores all fits.
    """
    train, base = table.part(task, "train"), linear_estimator(task)
    maps = random_params(base, name, draws, seed)
    jobs = [(d, f) for d in range(draws) for f in range(folds)]
    if task == "regression":
        moments = fold_moments(train, folds)
        spark = train.sparkSession
        seen = [rows_of_moments(spark, sum(m for k, m in moments.items() if k != f)) for f in range(folds)]
        with ThreadPoolExecutor(POOL) as workers:
            models = list(workers.map(lambda job: base.copy(maps[job[0]]).fit(seen[job[1]]), jobs))
        found = dict(enumerate(r2_of_moments(moments.get(f), m.intercept, m.coefficients.toArray()) for (_, f), m in zip(jobs, models, strict=True)))
    else:
        with ThreadPoolExecutor(POOL) as workers:
            models = list(workers.map(lambda job: base.copy(maps[job[0]]).fit(train.where(F.col("fold") != job[1])), jobs))
        parts = [(float(m.intercept), m.coefficients.toArray()) for m in models]

        def probability(intercept: float, coefficients: np.ndarray):
            return lambda z: 1 / (1 + np.exp(-(z @ coefficients + intercept)))

        held = _held_out(train.select("fold", "label", vector_to_array("linear").alias("z")), "z",
                         lambda fold: {i: probability(*parts[i]) for i, (_, f) in enumerate(jobs) if f == fold})
        found = {r["job"]: r[_primary(task)] for r in metrics_of(write_shared(held, "search-scores"), task, ["job"]).collect()}
    rows = [(d, f, float("-inf") if found.get(i) is None else float(found[i])) for i, (d, f) in enumerate(jobs)]
    return maps[best_draw(rows)], rows


def fold_moments(rows: DataFrame, folds: int) -> dict[int, np.ndarray]:
    """For each fold the sums of products of (1, the features, the label), from one pass over ``rows`` (fold, linear, label)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                z = np.column_stack([np.ones(len(part)), np.stack(part["z"].to_numpy()), part["label"].to_numpy("f8")])
                sums[int(fold)] = sums.get(int(fold), 0.0) + z.T @ z
        for fold, m in sums.items():
            yield pd.DataFrame({"fold": fold, "place": np.arange(m.size), "value": m.ravel()})

    narrow = rows.select("fold", vector_to_array("linear").alias("z"), "label")
    summed = narrow.mapInPandas(partial, "fold int, place long, value double").groupBy("fold", "place").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for fold, part in summed.groupby("fold"):
        values = part.sort_values("place")["value"].to_numpy()
        out[int(fold)] = values.reshape(math.isqrt(len(values)), -1)
    return out


def rows_of_moments(spark: SparkSession, moments: np.ndarray) -> DataFrame:
    """(linear, label): as many rows as ``moments`` has, whose sums of products of (1, features, label), times n over their number, are ``moments``.

    Any root R of the matrix has its moments (R'R); a reflection that turns the column of
    the ones into equal numbers keeps them, and divided by that number the rows are
    observations of one weight. So what depends on moments alone, as penalised least
    squares do, comes out as from all n rows.
    """
    if not np.ndim(moments):
        raise ValueError("no training rows")
    w, v = np.linalg.eigh(moments)
    root = np.sqrt(np.where(w > 1e-14 * w[-1], w, 0.0))[:, None] * v.T
    n = moments[0, 0]
    one = math.sqrt(n / len(root))
    u = root[:, 0] - one
    if u @ u > 0:
        root = root - np.outer(u, 2 * (u @ root) / (u @ u))
    rows, mean = root / one, moments[0] / n
    same = np.diag(moments) / n - mean**2 <= 1e-12 * np.diag(moments) / n
    rows[:, same] = mean[same]  # a feature without variance has none here either
    return spark.createDataFrame([(Vectors.dense(r[1:-1]), float(r[-1])) for r in rows], ["linear", "label"])


def r2_of_moments(moments: np.ndarray | None, intercept: float, coefficients: np.ndarray) -> float | None:
    """R² of a linear predictor over the rows behind ``moments``; None without rows or variance."""
    if moments is None:
        return None
    n, label = moments[0, 0], moments[-1]
    sst = label[-1] - label[0] ** 2 / n
    error = np.concatenate([[-intercept], -coefficients, [1.0]])
    return float(1 - error @ moments @ error / sst) if sst > 1e-12 * max(label[-1], 1e-300) else None


def best_draw(rows: Sequence[tuple[int, int, float]]) -> int:
    """The draw with the highest mean score; the first of equals."""
    by: dict[int, list[float]] = {}
    for d, _, v in rows:
        by.setdefault(d, []).append(v)
    return max(by, key=lambda d: (sum(by[d]) / len(by[d]), -d))


def fit_family(table: TrainingTable, task: str, name: str, *, tune: bool, draws: int = DRAWS, seed: int = SEED, rounds: int = ROUNDS, trees: int = TREES):
    """(model, parameters found, scores of the test rows) of one family."""
    test = table.part(task, "test")
    if name in TREE_FAMILIES:
        params = search_trees(table, task, name, draws=draws, seed=seed, rounds=rounds, trees=trees)[0] if tune else tree_params(name, rounds, trees)
        members = fit_committees(packed_shards(table, task), [(params, None)], task, table.n_numeric(task), seed=seed)
        model = Committee.of(members, 0)
        return model, params, model.score(test)
    chosen = search_linear(table, task, name, draws=draws, seed=seed)[0] if tune else {}
    model = linear_estimator(task).copy(chosen).fit(table.part(task, "train"))
    return model, {p.name: v for p, v in chosen.items()}, linear_score(model, test, task)


def benchmark(
    df: DataFrame, spec: TableSpec, *, tune: bool = True, seed: int = SEED, rounds: int = ROUNDS, trees: int = TREES, draws: int = DRAWS,
    families: Sequence[str] | None = None, pool: int = POOL, root: str | None = None, table: TrainingTable | None = None,
) -> DataFrame:
    """Every family of every task, searched, fitted, scored on the test rows, saved and logged.

    The leakage run is never tuned. Returns the long metrics table (task, model,
    metric, value); models, feature lists and runs are under ``root``.
    """
    spark = df.sparkSession
    table = table or training_table(df, spec, seed=seed)
    root = root or benchmark_root(spark)
    jobs = [(task, name) for task in TASKS for name in FAMILIES[task] if families is None or name in families]
    for task in TASKS:
        packed_shards(table, task)

    def one(job: tuple[str, str]) -> tuple:
        task, name = job
        model, params, scored = fit_family(table, task, name, tune=tune and not task.endswith("leaked"), draws=draws, seed=seed, rounds=rounds, trees=trees)
        found = metrics_of(scored, task).first().asDict()
        return task, name, model, params, {k: v for k, v in found.items() if k != "n"}

    with ThreadPoolExecutor(pool) as workers:
        done = list(workers.map(one, jobs))
    rows = []
    for task, name, model, params, found in done:
        features, path = table.features(task), os.path.join(root, task, name)
        if isinstance(model, Committee):
            model.save(spark, path, features)
        else:
            save_model(PipelineModel(stages=[*table.encoder.stages, model]), path, features)
        log_run(spark, os.path.join(root, "runs"), model=name, task=task, params={"n_features": len(features), "tuned": tune and not task.endswith("leaked"), **params},
                metrics={k: v for k, v in found.items() if v is not None})
        rows += [(task, name, k, None if v is None else float(v)) for k, v in found.items()]
    return spark.createDataFrame(rows, "task string, model string, metric string, value double")


def benchmark_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "ledgerlens-out", "benchmark")


def logged_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(task, model, metric, value) of the newest run of each task and model, from the run log."""
    runs = spark.read.parquet(os.path.join(root, "runs")).where("kind = 'metric'")
    last = runs.groupBy("task", "model").agg(F.max_by("run_id", "ts").alias("run_id"))
    return runs.join(last, ["task", "model", "run_id"]).select("task", "model", F.col("name").alias("metric"), "value")


# -- K15 permutation importance ---------------------------------------------------------------
#: Times a place may walk until it is below n; each step stays above with a chance of a quarter at most.
WALK = 32


def keyed_place(rank: Column, n: int, key: Column) -> Column:
    """A pseudo-random bijection of 0..n-1 for each ``key``: a Feistel network over a grid that is hardly larger, walked until it is below ``n``.

    A rank is a cell (l, r) of a grid of about sqrt(n) by sqrt(n). Each of four rounds
    turns one coordinate by a hash of the other, the key and the round, which can be
    undone; so can the walk, as it stays on the cell's own cycle.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        state = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        turned = lambda own, other, i, size: F.pmod(own + F.pmod(F.xxhash64(other, key, i), F.lit(size)), F.lit(size)).cast("long")
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), state, lambda s, i: F.struct(
            F.when(i % 2 == 1, turned(s["l"], s["r"], i, a)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, turned(s["r"], s["l"], i, b)).otherwise(s["r"]).alias("r")),
            lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(rank.cast("long")), lambda x, _: F.when(x >= F.lit(n), once(x)).otherwise(x))


#: Replicas of each column's permutation.
REPLICAS = 5


def permutation_importance(rows: DataFrame, predict, columns: Sequence[str], *, replicas: int = REPLICAS, seed: int = SEED) -> DataFrame:
    """Per column, the mean and deviation over replicas of the fall in R² when that column's values change rows.

    ``rows`` has row_key, label and ``x``; ``predict`` scores a matrix and is sent to the
    tasks. The rows are ranked once. In replica r of column j the row of rank i takes
    the value of the row of rank ``keyed_place(i)``: one narrow exploded table (replica,
    column, rank, value) is joined to the rows by rank, so no column is ever collected.
    All replicas of all columns are scored in one job, whose sums of squares by
    (column, replica) give the scores. If ``predict`` names the columns it reads
    (``used``), the others are neither sent nor scored: its scores stay what they are, a
    fall of 0. The rows as they are need scoring once.
    """
    narrow = rows.select("row_key", "label", "x")
    ranked = write_shared(
        cumulative_counts(narrow.select(F.struct(hash_order(F.col("row_key"), seed).alias("h"), "row_key").alias("place"), F.struct("label", "x").alias("row")), [], "place", unique_values=True)
        .select((F.col("cum") - 1).alias("rank"), "row.label", "row.x"), "importance-rows")
    n = ranked.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "feature string, importance double, importance_std double")
    width = len(columns)
    asked = sorted(getattr(predict, "used", range(width)))
    moves = F.array(*[F.lit(r) for r in range(replicas)])
    sent = ranked.select("rank", "x", F.explode(moves).alias("replica")).select(
        "replica", "rank", F.posexplode("x").alias("column", "value")).where(F.col("column").isin(asked))
    key = F.col("column") * replicas + F.col("replica") + seed
    sent = sent.select("replica", "column", keyed_place(F.col("rank"), n, key).alias("rank"), "value")
    # what each row receives, all columns of a replica together
    received = sent.groupBy("rank", "replica").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("got"))
    joined = received.join(ranked, "rank")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            got = np.stack([np.array([g["value"] for g in row]) for row in pdf["got"]])
            y = pdf["label"].to_numpy("f8")
            for r, at in pdf.groupby("replica").indices.items():
                found = asked if r else [*asked, -1]  # with each column moved, and once as they are
                moved = np.tile(x[at], (len(found), 1, 1))
                for k, j in enumerate(asked):
                    moved[k, :, j] = got[at, k]
                error = y[at] - predict(moved.reshape(-1, width)).reshape(len(found), -1)
                yield pd.DataFrame({"column": found, "replica": int(r), "sse": (error**2).sum(axis=1)})

    sums = write_shared(joined.mapInPandas(score, "column int, replica int, sse double").groupBy("column", "replica").agg(F.sum("sse").alias("sse")), "importance-sums")
    sst = ranked.agg((F.var_pop("label") * F.count(F.lit(1))).alias("s")).first()["s"]
    base = sums.where("column < 0").first()
    fall = F.try_divide(F.col("sse") - F.lit(base["sse"] if base else None), F.lit(sst))
    per = sums.where("column >= 0").groupBy("column").agg(F.avg(fall).alias("importance"), F.stddev_pop(fall).alias("importance_std"))
    none = F.try_divide(F.lit(0.0), F.lit(sst))
    unread = [j for j in range(width) if j not in asked]
    if unread:
        per = per.unionByName(rows.sparkSession.createDataFrame([(j,) for j in unread], "column int").select("column", none.alias("importance"), none.alias("importance_std")))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column") + 1)
    return per.select(names.alias("feature"), "importance", "importance_std").orderBy(F.desc("importance"), "feature")


# -- I11 positive control ---------------------------------------------------------------------
def positive_control(real: TrainingTable, planted: TrainingTable, *, family: str = "Boosted", seed: int = SEED, rounds: int = AUDIT_ROUNDS) -> DataFrame:
    """The same learner on the given target and on one that depends on the features."""
    r2 = []
    for table in (real, planted):
        _, _, scored = fit_family(table, "regression", family, tune=False, seed=seed, rounds=rounds, trees=rounds)
        r2.append(regression_metrics(scored, "label", "score").first()["r2"])
    validated = bool(r2[1] is not None and r2[1] > CONTROL_R2)
    verdict = (f"the learner finds a planted signal (R2 {r2[1]:.3f}); on the given target its R2 is {r2[0]:.3f}"
               if validated else f"the learner misses a planted signal (R2 {r2[1]}): no conclusion")
    return real.rows.sparkSession.createDataFrame(
        [(family, r2[0], r2[1], validated, verdict)], "model string, r2_real double, r2_synthetic double, pipeline_validated boolean, verdict string")


# -- K11 conformal scores of a fitted learner ---------------------------------------------------
def conformal_scores(table: TrainingTable, *, family: str = "Boosted", seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """(label, score, role): a learner fitted on the first half of the training rows by a hash of the key, its scores of the other half ('cal') and of the test rows ('test'), written once."""
    hashed = table.part("regression", "train").withColumn("_half", hash_rank_key(F.col("row_key"), seed, "cal"))
    cut = order_statistics(hashed, [], "_half", {"at": lambda n: F.greatest(F.floor(n / 2), F.lit(1)) - 1}).first()
    if cut is None:
        raise ValueError("no training rows")
    first = F.col("_half") <= F.lit(cut["at"])
    params = tree_params(family, rounds, rounds)
    shards = packed_shards(table, "regression", part=hashed.where(first), name="conformal")
    model = Committee.of(fit_committees(shards, [(params, None)], "regression", table.n_numeric("regression"), seed=seed), 0)
    scored = model.score(hashed.where(~first)).withColumn("role", F.lit("cal")).unionByName(model.score(table.part("regression", "test")).withColumn("role", F.lit("test")))
    return write_shared(scored.select("label", "score", "role"), "conformal")
