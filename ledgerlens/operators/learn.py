"""Table-scale learning: splits, metrics, conformal intervals, cross-validation,
learning curves and permutation tests (K1, K2, K7, K8, K11–K13, K16, I9).

Closed-form scorers (group means, linear fits) run as grouped aggregates, so
every fold, size and permutation is one Spark job instead of a driver loop. The
learners' training table, fits and searches are in :mod:`ledgerlens.operators.training`.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.hashrand import hash_order, hash_rank_key, hash_uniform
from ledgerlens.operators.features import add_engineered_features, select_features
from ledgerlens.operators.ranks import cumulative_counts, exact_percentiles, order_statistics
from ledgerlens.session import write_shared
from ledgerlens.spec import CONFORMAL_INFORMATIVE, SEED, SIGNIFICANCE, TableSpec

TEST_SHARE, VAL_SHARE = 0.15, 0.15


# -- K1 split --------------------------------------------------------------------------
def assign_split(df: DataFrame, key: str, *, seed: int = SEED, test: float = TEST_SHARE, val: float = VAL_SHARE,
                 stratify: str | None = None, exact: bool = True, rank: str | None = None) -> DataFrame:
    """K1: add ``split`` ∈ {train, val, test}; seeded, optionally stratified.

    Exact mode orders rows within each stratum by a hash of key and seed, takes the
    first ``ceil(n·test)`` as test and the next ``ceil((n − n_test)·val/(1 − test))``
    as validation. Only the two cut points per stratum are looked up (bucket
    counts); rows are labelled by comparison, so none is sorted or shuffled.
    ``exact=False`` uses fixed hash thresholds instead (sizes within sampling error).
    ``rank`` names a column that holds the hash already.
    """
    rel_val = val / (1.0 - test)
    if not exact:
        u = hash_uniform(F.col(key), seed)
        return df.withColumn("split", F.when(u < test, "test").when(u < test + (1 - test) * rel_val, "val")
                             .otherwise("train"))
    groups = [stratify] if stratify else []
    hashed = df.withColumn("_h", F.col(rank) if rank else hash_rank_key(F.col(key), seed))
    n_test = lambda n: F.ceil(n * F.lit(test))
    n_val = lambda n: F.ceil((n - n_test(n)) * F.lit(rel_val))
    cuts = order_statistics(hashed, groups, "_h", {
        "_test": lambda n: n_test(n) - 1, "_val": lambda n: F.least(n_test(n) + n_val(n), n) - 1})
    if groups:
        cut = cuts.select(F.col(stratify).alias("_stratum"), "_test", "_val")
        hashed = hashed.join(cut, F.col(stratify).eqNullSafe(F.col("_stratum")), "left")
    else:
        row = cuts.first()
        hashed = hashed.withColumns({"_test": F.lit(row["_test"] if row else None).cast("long"), "_val": F.lit(row["_val"] if row else None).cast("long")})
    split = F.when(F.col("_h") <= F.col("_test"), "test").when(F.col("_h") <= F.col("_val"), "val").otherwise("train")
    return hashed.withColumn("split", split).drop("_h", "_test", "_val", "_stratum")


# -- K2 preprocessing ------------------------------------------------------------------
def preprocessing_stages(numeric: Sequence[str], categorical: Sequence[str], out: str = "features"):
    """K2: index + one-hot (unknown level -> all zeros) + assemble + standardise."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical],
                        outputCols=[f"{c}__ohe" for c in categorical], dropLast=True, handleInvalid="error")
    raw = VectorAssembler(inputCols=list(numeric), outputCol="__num", handleInvalid="keep")
    scaler = StandardScaler(inputCol="__num", outputCol="__num_z", withMean=True, withStd=True)
    assemble = VectorAssembler(inputCols=["__num_z", *[f"{c}__ohe" for c in categorical]], outputCol=out)
    stages = [*idx]
    if categorical:
        stages.append(ohe)
    return stages + [raw, scaler, assemble]


def standardize(df: DataFrame, columns: Sequence[str], fit_on: Column) -> DataFrame:
    """K2 (SQL form): z-scores with population std, statistics from rows where ``fit_on``."""
    stats = df.where(fit_on).agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
                                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")
                                   for i, c in enumerate(columns)]).first()
    return df.withColumns({
        f"{c}_z": (F.col(c).cast("double") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or float("nan"))
        for i, c in enumerate(columns)
    })


# -- K7 / K8 metrics -------------------------------------------------------------------
def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """K7: R² = 1 − SSE/SST, RMSE, MAE in one aggregate (per ``by`` group)."""
    e = F.col(y).cast("double") - F.col(yhat).cast("double")
    yv = F.col(y).cast("double")
    agg = df.groupBy(*by).agg(
        F.sum(e * e).alias("_sse"), F.var_pop(yv).alias("_var"),
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs(e)).alias("_sae"),
    )
    sst = F.col("_var") * F.col("_n")
    return agg.select(
        *by,
        (F.lit(1.0) - F.try_divide(F.col("_sse"), sst)).alias("r2"),
        F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"),
        (F.col("_sae") / F.col("_n")).alias("mae"),
        F.col("_n").alias("n"),
    )


def _score_table(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score (and ``by`` group): rows ``k``, positives ``p`` and the
    running count ``cum`` from the distributed rank helper."""
    pos = F.sum(F.col(label).cast("long"))
    return cumulative_counts(df.select(*by, label, score), list(by), score, extra_aggs={"p": pos})


def _auc_expr() -> tuple[list, Column]:
    midrank = (F.col("cum") - F.col("k")).cast("double") + (F.col("k") + 1) / 2.0
    aggs = [F.sum(F.col("p") * midrank).alias("_r"), F.sum("p").alias("_P"), F.sum("k").alias("_N")]
    big_p = F.col("_P").cast("double")
    u = F.col("_r") - big_p * (big_p + 1) / 2.0
    return aggs, F.try_divide(u, big_p * (F.col("_N") - F.col("_P"))).alias("roc_auc")


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """K8: exact ROC-AUC with tied scores averaged (Mann–Whitney on mid-ranks).

    Per distinct score: k rows of which p positive; mid-rank = (cum − k) + (k + 1)/2.
    AUC = (Σ p·midrank − P(P+1)/2) / (P·Q). A one-class group gives NULL.
    """
    aggs, auc = _auc_expr()
    return _score_table(df, label, score, by).groupBy(*by).agg(*aggs).select(*by, auc)


def classification_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
                           threshold: float = 0.5) -> DataFrame:
    """K8: ROC-AUC, accuracy and F1 (0 when undefined) of ``score >= threshold``.

    All three come from the same per-score table: TP, FP and FN are sums of
    positives / negatives on either side of the threshold.
    """
    aggs, auc = _auc_expr()
    hi = F.col(score) >= F.lit(threshold)
    neg = F.col("k") - F.col("p")
    aggs += [F.sum(F.when(hi, F.col("p")).otherwise(0)).alias("_tp"),
             F.sum(F.when(hi, neg).otherwise(0)).alias("_fp"),
             F.sum(F.when(~hi, F.col("p")).otherwise(0)).alias("_fn")]
    agg = _score_table(df, label, score, by).groupBy(*by).agg(*aggs)
    tn = F.col("_N") - F.col("_P") - F.col("_fp")
    accuracy = (F.col("_tp") + tn).cast("double") / F.col("_N")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("_tp"), 2.0 * F.col("_tp") + F.col("_fp") + F.col("_fn")), F.lit(0.0))
    return agg.select(*by, auc, accuracy.alias("accuracy"), f1.alias("f1"))


# -- group-mean predictor (closed-form scorer) -------------------------------------------
def group_mean_predictions(train: DataFrame, score: DataFrame, group: str, y: str, out: str = "yhat") -> DataFrame:
    """ŷ = mean of y per group learned on ``train``; unseen groups get the overall mean."""
    overall = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
    means = train.groupBy(group).agg(F.avg(F.col(y).cast("double")).alias("_gm"))
    return score.join(means, group, "left").withColumn(out, F.coalesce(F.col("_gm"), F.lit(overall))).drop("_gm")


# -- K11 split conformal --------------------------------------------------------------
def split_conformal(scored: DataFrame, y: str, yhat: str, role: str, *, alpha: float | Sequence[float] = 0.1) -> DataFrame:
    """Half-width = quantile of |y − ŷ| on calibration rows at
    ``min(ceil((n+1)(1−α))/n, 1)`` (linear interpolation); coverage, width and
    informativeness on test rows. ``role`` marks rows 'cal' or 'test'.

    Any number of alphas: the residuals are written once, one selection finds the
    half-widths of all, and one aggregate counts what each covers. A row per alpha.
    """
    alphas = [alpha] if isinstance(alpha, (int, float)) else list(alpha)
    yv = F.col(y).cast("double")
    res = write_shared(scored.select(F.col(role).alias("_role"), yv.alias("_y"), F.abs(yv - F.col(yhat)).alias("_score")), "residuals")
    cal, test = res.where("_role = 'cal'"), res.where("_role = 'test'")
    n = cal.count()
    if not n:
        raise ValueError("no calibration rows")
    levels = {f"hw{i}": min(math.ceil((n + 1) * (1 - a)) / n, 1.0) for i, a in enumerate(alphas)}
    widths = exact_percentiles(cal.select("_score"), [], "_score", levels).first()
    row = test.agg(
        *[F.avg((F.col("_score") <= F.lit(widths[f"hw{i}"])).cast("double")).alias(f"c{i}") for i in range(len(alphas))],
        F.stddev_pop("_y").alias("std"), (F.max("_y") - F.min("_y")).alias("range")).first()
    rows = []
    for i, a in enumerate(alphas):
        hw = float(widths[f"hw{i}"])
        relative = 2.0 * hw / row["range"] if row["range"] else 0.0
        rows.append((float(a), hw, row[f"c{i}"], row["std"], row["range"], relative, relative < CONFORMAL_INFORMATIVE, n))
    return scored.sparkSession.createDataFrame(
        rows, "alpha double, half_width double, coverage double, target_std double, target_range double, relative_width double, is_informative boolean, n_calibration long")


def conformal_roles(df: DataFrame, key: str, *, seed: int = SEED, split: DataFrame | None = None) -> DataFrame:
    """Rows for K11: 'test' from the K1 split; train rows halved into 'fit' / 'cal'
    by rank of md5(key:seed:cal) (exactly ⌊n_train/2⌋ fit rows); validation rows unused.
    ``split`` reuses an already computed K1 split of ``df``."""
    split = split if split is not None else assign_split(df, key, seed=seed)
    train = split.where(F.col("split") == "train")
    hashed = train.withColumn("_h2", hash_rank_key(F.col(key), seed, "cal"))
    cut = order_statistics(hashed, [], "_h2", {"_fit": lambda n: F.greatest(F.floor(n / 2), F.lit(1)) - 1}).first()
    fit = F.lit(False) if cut is None or cut["n"] < 2 else F.col("_h2") <= F.lit(cut["_fit"])
    roles = hashed.withColumn("role", F.when(fit, "fit").otherwise("cal")).drop("_h2")
    test = split.where(F.col("split") == "test").withColumn("role", F.lit("test"))
    return roles.unionByName(test)


# -- K12 / K13 cross-validation and learning curve (group-mean scorer) ---------------------
def _fold(key: str, k: int, seed: int) -> Column:
    return F.least(F.floor(hash_uniform(F.col(key), seed, "fold") * k), F.lit(k - 1)).cast("int")


def _moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, sum, mean and variance of ``_y`` per ``keys``: one partial aggregate of the rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v"))


def _r2_from_moments(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """R² per ``by`` from cells (n, m, v, yhat): squared errors are n·(v + (m − ŷ)²).

    The total is taken around the mean of the cells' means, so nothing large cancels.
    """
    centre = cells.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_centre"))
    both = cells.join(centre, list(by))
    around = lambda c: F.sum(F.col("n") * (F.col("v") + (F.col("m") - c) * (F.col("m") - c)))
    return both.groupBy(*by).agg(around(F.col("yhat")).alias("_sse"), around(F.col("_centre")).alias("_sst"), F.sum("n").alias("n")).select(
        *by, (F.lit(1.0) - F.try_divide("_sse", "_sst")).alias("r2"), "n")


def kfold_group_mean(train: DataFrame, key: str, group: str, y: str, *, k: int = 5, seed: int = SEED) -> DataFrame:
    """K-fold R² of the group-mean predictor from (group, fold) moments.

    For fold f the prediction is (S_g − S_{g,f}) / (N_g − N_{g,f}); rows whose
    group is absent outside f get the overall out-of-fold mean. The rows are read
    in one aggregate; everything after it is group-sized.
    """
    d = train.select(F.col(group).alias("_g"), F.col(y).cast("double").alias("_y"), _fold(key, k, seed).alias("fold"))
    gf = write_shared(_moments(d, ["_g", "fold"]), "folds")
    g = gf.groupBy("_g").agg(F.sum("s").alias("s_g"), F.sum("n").alias("n_g"))
    tot = gf.groupBy("fold").agg(F.sum("s").alias("s_f"), F.sum("n").alias("n_f"))
    whole = gf.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    outside = F.try_divide(F.col("s_g") - F.col("s"), (F.col("n_g") - F.col("n")).cast("double"))
    overall = F.try_divide(F.lit(whole["s"]) - F.col("s_f"), (F.lit(whole["n"]) - F.col("n_f")).cast("double"))
    cells = gf.join(g, gf["_g"].eqNullSafe(g["_g"])).join(tot, "fold").withColumn("yhat", F.coalesce(outside, overall))
    return _r2_from_moments(cells.select("fold", "n", "m", "v", "yhat"), ["fold"])


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean ± population std of the fold scores."""
    return folds.agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"), F.count(F.lit(1)).alias("k"))


def learning_curve_group_mean(train: DataFrame, key: str, group: str, y: str, *, k: int = 3, seed: int = SEED,
                              fractions: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0)) -> DataFrame:
    """Mean test-fold R² per training-size fraction; each size ⊂ the next.

    A row is in the size-s training set of fold f when it is outside f and its
    hash uniform is below s. One aggregate gives the moments per (group, fold,
    size step); training sets are sums over other folds and smaller steps.
    """
    u = hash_uniform(F.col(key), seed, "size")
    step = F.lit(len(fractions))
    for i, size in reversed(list(enumerate(fractions))):
        step = F.when(u < F.lit(float(size)), F.lit(i)).otherwise(step)
    d = train.select(F.col(group).alias("_g"), F.col(y).cast("double").alias("_y"), _fold(key, k, seed).alias("fold"), step.alias("step"))
    cells = write_shared(d.groupBy("_g", "fold", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")), "curve")
    tests = write_shared(_moments(d, ["_g", "fold"]), "curve-tests").withColumnRenamed("fold", "tfold")
    sizes = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(float(x)).alias("size")) for i, x in enumerate(fractions)])
    folds = F.array(*[F.lit(i) for i in range(k)])
    used = (cells.withColumn("z", F.explode(sizes)).withColumn("tfold", F.explode(folds))
            .where((F.col("tfold") != F.col("fold")) & (F.col("step") <= F.col("z.at"))).withColumn("size", F.col("z.size")))
    stats = used.groupBy("size", "tfold", F.col("_g").alias("_tg")).agg(F.sum("s").alias("s_t"), F.sum("n").alias("n_t"))
    overall = used.groupBy("size", "tfold").agg((F.sum("s") / F.sum("n")).alias("overall"), F.sum("n").alias("n_train"))
    asked = tests.withColumn("size", F.explode(F.array(*[F.lit(float(x)) for x in fractions])))
    same = (asked["size"] == stats["size"]) & (asked["tfold"] == stats["tfold"]) & asked["_g"].eqNullSafe(stats["_tg"])
    scored = asked.join(stats.select("size", "tfold", "_tg", "s_t", "n_t"), same, "left").select(
        asked["size"], asked["tfold"], "n", "m", "v", "s_t", "n_t").join(overall, ["size", "tfold"])
    scored = scored.withColumn("yhat", F.coalesce(F.col("s_t") / F.col("n_t"), F.col("overall")))
    per = _r2_from_moments(scored, ["size", "tfold"]).join(overall, ["size", "tfold"])
    return per.groupBy("size").agg(F.avg("r2").alias("r2_mean"), F.avg("n_train").alias("n_train_mean"))


# -- I9 permutation test (group-mean scorer) ------------------------------------------
#: A prime above any row count: its powers are coprime to the row count, so each is a bijection.
PERM_PRIME, PERM_SHIFT = (1 << 61) - 1, 1_000_003


def _group_at(position: Column, groups: list, ends: list[int]) -> Column:
    """Index of the interval that holds ``position``, as a balanced tree of comparisons."""
    if len(groups) == 1:
        return F.lit(groups[0])
    mid = len(groups) // 2
    return F.when(position < F.lit(ends[mid - 1]), _group_at(position, groups[:mid], ends[:mid])).otherwise(
        _group_at(position, groups[mid:], ends[mid:]))


def permutation_test_group_mean(split: DataFrame, key: str, group: str, y: str, *, n_perm: int = 30,
                                seed: int = SEED) -> DataFrame:
    """Observed held-out R² vs R² under P label shuffles of the train rows (see :func:`_permuted_predictions`)."""
    scored = _permuted_predictions(split, key, group, y, n_perm)
    return _r2_from_moments(scored.select("perm", "n", "m", "v", "yhat"), ["perm"]).select("perm", "r2")


def permutation_auc_group_mean(split: DataFrame, key: str, group: str, label: str, *, n_perm: int = 30, seed: int = SEED) -> DataFrame:
    """Observed held-out ROC-AUC vs that under P label shuffles of the train rows.

    A test group's rows share a score, so the AUC follows from the groups' positives
    and negatives by (permutation, score): ties get mid-ranks, and what is ordered per
    permutation is at most as long as there are groups. Null where a class is absent.
    """
    scored = _permuted_predictions(split, key, group, label, n_perm)
    cells = scored.groupBy("perm", "yhat").agg(F.sum(F.round(F.col("n") * F.col("m"))).alias("p"), F.sum("n").alias("k"))
    cells = cells.withColumn("q", F.col("k") - F.col("p"))
    below = Window.partitionBy("perm").orderBy("yhat").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0.0)) + F.col("q") / 2.0)
    return cells.withColumn("won", won).groupBy("perm").agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("q")).alias("roc_auc"))


def _permuted_predictions(split: DataFrame, key: str, group: str, y: str, n_perm: int) -> DataFrame:
    """Moments (n, m, v) of each test group beside the mean ``yhat`` that permutation ``perm`` gives it (0: the labels as they are).

    The train labels are ranked once, by a hash of the key. Permutation p sends the
    label of rank j to place (a_p·j + b_p) mod n, with a_p the p-th power of a prime
    mod n and b_p a multiple of p; places belong to the groups in name order, each
    with as many as it has rows. So one pass gives the sums per (permutation,
    group), without a sort or a join per permutation, and scores follow from the
    moments of the test groups.
    """
    yv = F.col(y).cast("double")
    part = lambda name: split.where(F.col("split") == name).select(F.col(key), F.col(group).cast("string").alias("_g"), yv.alias("_y"))
    train = part("train")
    tests = write_shared(_moments(part("test"), ["_g"]), "perm-tests")
    observed = train.groupBy("_g").agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = observed.orderBy("_g").collect()  # one row per group: the model itself
    n = sum(r["n"] for r in rows)
    ends, at = [], 0
    for r in rows:
        at += r["n"]
        ends.append(at)
    ranked = cumulative_counts(train.select("_y", F.unhex(hash_order(F.col(key), 0)).alias("_h")), [], "_h", unique_values=True)
    kind = "long" if n < 1 << 31 else "decimal(38,0)"  # a_p·j must not overflow
    maps = F.array(*[F.struct(F.lit(p).alias("perm"), F.lit(pow(PERM_PRIME, p, max(n, 1))).cast(kind).alias("a"),
                              F.lit(p * PERM_SHIFT % max(n, 1)).cast(kind).alias("b")) for p in range(1, n_perm + 1)])
    moved = ranked.select((F.col("cum") - 1).cast(kind).alias("_j"), "_y", F.explode(maps).alias("t"))
    place = ((F.col("t.a") * F.col("_j") + F.col("t.b")) % F.lit(max(n, 1)).cast(kind)).cast("long")
    moved = moved.select(F.col("t.perm").alias("perm"), place.alias("_place"), "_y")
    spread = moved.groupBy("perm", _group_at(F.col("_place"), list(range(len(rows))), ends).alias("_i")).agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n"))
    names = split.sparkSession.createDataFrame([(i, r["_g"]) for i, r in enumerate(rows)], "_i int, _g string")
    means = write_shared(spread.join(names, "_i").select("perm", "_g", "s", "n").unionByName(
        observed.select(F.lit(0).alias("perm"), "_g", "s", "n")), "perm-means")
    overall = means.groupBy("perm").agg((F.sum("s") / F.sum("n")).alias("_m"))
    asked = tests.withColumn("perm", F.explode(F.array(*[F.lit(p) for p in range(0, n_perm + 1)])))
    learned = means.select(F.col("perm").alias("_p"), F.col("_g").alias("_tg"), (F.col("s") / F.col("n")).alias("_gm"))
    same = (asked["perm"] == learned["_p"]) & asked["_g"].eqNullSafe(learned["_tg"])
    return asked.join(learned, same, "left").join(overall, "perm").withColumn("yhat", F.coalesce("_gm", "_m"))


def permutation_pvalue(scores: DataFrame) -> DataFrame:
    """Observed score, null mean/std and the one-sided p-value with its verdict."""
    observed = scores.where("perm = 0").select(F.col("r2").alias("observed"))
    nulls = scores.where("perm > 0")
    s = nulls.agg(F.avg("r2").alias("null_mean"), F.stddev_pop("r2").alias("null_std"),
                  F.count(F.lit(1)).alias("n_permutations"))
    obs = observed.first()["observed"]
    ge = nulls.where(F.col("r2") >= F.lit(obs)).count()
    return s.select(
        F.lit(obs).alias("observed"), "null_mean", "null_std", "n_permutations",
        ((F.lit(ge) + 1) / (F.col("n_permutations") + 1)).alias("p_value"),
    ).withColumn("has_signal", F.col("p_value") < SIGNIFICANCE)


# -- K3–K6, K9, K16 Spark ML learners ---------------------------------------------------
#: Boosting rounds and trees: of the benchmark, conformal and capability learners, and of the audit's scorer.
ROUNDS, AUDIT_ROUNDS, TREES = 400, 150, 400
RATE, LEAVES_DEPTH = 0.05, 5  # 2^5 = 32 leaves at most
def random_params(est, name: str, n_iter: int, seed: int) -> list[dict]:
    """K5: ``n_iter`` penalty settings of a linear family drawn at random."""
    rng = random.Random(f"{name}:{seed}")
    return [{est.regParam: math.exp(rng.uniform(math.log(1e-6), math.log(1.0))), est.elasticNetParam: rng.uniform(0.0, 1.0)} for _ in range(n_iter)]


def model_frame(df: DataFrame, spec: TableSpec, task: str, *, include_leakage: bool = False) -> tuple:
    """Features + ``label`` (target) for a task; the leaked label column is dropped."""
    data = add_engineered_features(df, spec)
    numeric, categorical = select_features(data, spec, include_leakage=include_leakage)
    if task == "regression":
        label = F.col(spec.volume).cast("double")
    else:
        label = (F.col(spec.label) == spec.positive_label).cast("double")
    keep = [spec.key, *numeric, *[F.col(c).cast("string").alias(c) for c in categorical]]
    out = data.select(*keep, label.alias("label"))
    return out, numeric, categorical


def mlp_classifier(train: DataFrame, test: DataFrame, numeric, categorical, *, seed: int = SEED,
                   hidden=(128, 64), max_iter: int = 100):
    """Multilayer perceptron [d, 128, 64, 2] for the classification task."""
    pre = Pipeline(stages=preprocessing_stages(numeric, categorical)).fit(train)
    tr = pre.transform(train)
    d = len(tr.select("features").first()["features"])
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[d, *hidden, 2],
                                         seed=seed, maxIter=max_iter)
    model = mlp.fit(tr)
    pred = model.transform(pre.transform(test)).withColumn("score", vector_to_array("probability")[1])
    m = classification_metrics(pred, "label", "score").first()
    return PipelineModel(stages=[*pre.stages, model]), {"roc_auc": m["roc_auc"], "accuracy": m["accuracy"],
                                                        "f1": m["f1"]}


def best_models(metrics: DataFrame) -> DataFrame:
    """Per task, the model with the best primary metric (r2 / roc_auc)."""
    primary = metrics.where(((F.col("task") == "regression") & (F.col("metric") == "r2"))
                            | ((F.col("task") != "regression") & (F.col("metric") == "roc_auc")))
    primary = primary.where(F.col("value").isNotNull())
    if not primary.limit(1).count():
        raise ValueError("no model has a primary metric")
    return primary.groupBy("task").agg(
        F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best_model"),
        F.max("value").alias("best_value"),
    )
