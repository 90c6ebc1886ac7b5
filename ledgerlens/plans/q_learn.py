"""Queries: splits, metrics, conformal, CV, learning curve, permutation test, learners
(K1–K16, I9, I11, I13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import audit as AU
from ledgerlens.operators import learn as LN
from ledgerlens.operators import panel as PN
from ledgerlens.operators import regress as RG
from ledgerlens.operators import training as TR
from ledgerlens.plans.catalogue import facts, facts_signature, register
from ledgerlens.session import write_shared
from ledgerlens.plans.oracle import SPEC, hash_uniform_sql, with_sales

SEED = 42
D15 = "CAST(0.15 AS DOUBLE)"
REL_VAL = "(CAST(0.15 AS DOUBLE) / CAST(0.85 AS DOUBLE))"


def _split_ctes(stratified: bool) -> str:
    part = "PARTITION BY label" if stratified else ""
    return f"""
lab AS (SELECT row_key, Model, CAST(Sales_Volume AS DOUBLE) AS y, Price_USD, Mileage_KM,
               CASE WHEN Sales_Classification = 'High' THEN 1 ELSE 0 END AS label FROM sales),
rk AS (SELECT *, row_number() OVER ({part} ORDER BY md5(row_key || ':{SEED}')) AS rn,
              COUNT(*) OVER ({part}) AS n FROM lab),
spl AS (SELECT *, CASE WHEN rn <= ceil(n * {D15}) THEN 'test'
                       WHEN rn <= ceil(n * {D15}) + ceil((n - ceil(n * {D15})) * {REL_VAL}) THEN 'val'
                       ELSE 'train' END AS split FROM rk)""".strip()


def _labelled(spark, d):
    f = facts(spark, d)
    return f.select("row_key", SPEC.model, F.col(SPEC.volume).cast("double").alias("y"), SPEC.price, SPEC.mileage,
                    (F.col(SPEC.label) == SPEC.positive_label).cast("int").alias("label"))


_SPLITS: dict = {}


def _split(spark, d, stratified: bool):
    """The K1 split of the labelled facts, written once to the shared folder and
    reused by every job that trains or scores on it (metrics, CV, conformal,
    permutation test)."""
    key = (spark.sparkContext.applicationId, d, facts_signature(spark, d), stratified)
    if key not in _SPLITS:
        split = LN.assign_split(_labelled(spark, d), "row_key", seed=SEED, stratify="label" if stratified else None)
        _SPLITS[key] = write_shared(split, "split")
    return _SPLITS[key]


register("train_val_test_split", "K1",
         with_sales("SELECT row_key, split FROM spl", extra_ctes=_split_ctes(True)))(
    lambda spark, d: _split(spark, d, True).select("row_key", "split")
)
register("split_sizes", "K1",
         with_sales("SELECT split, label, COUNT(*) AS n FROM spl GROUP BY split, label", extra_ctes=_split_ctes(True)))(
    lambda spark, d: _split(spark, d, True).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
)


def _standardized(spark, d):
    s = LN.standardize(_split(spark, d, True), [SPEC.price, SPEC.mileage], F.col("split") == "train")
    return s.select("row_key", *[F.round(f"{c}_z", 9).alias(f"{c}_z") for c in (SPEC.price, SPEC.mileage)])


register(
    "standardized_numeric", "K2",
    with_sales("""
SELECT row_key, ROUND((CAST(Price_USD AS DOUBLE) - mp) / sp, 9) AS Price_USD_z,
       ROUND((CAST(Mileage_KM AS DOUBLE) - mm) / sm, 9) AS Mileage_KM_z
FROM spl, (SELECT avg(CAST(Price_USD AS DOUBLE)) AS mp, stddev_pop(CAST(Price_USD AS DOUBLE)) AS sp,
                  avg(CAST(Mileage_KM AS DOUBLE)) AS mm, stddev_pop(CAST(Mileage_KM AS DOUBLE)) AS sm
           FROM spl WHERE split = 'train') st""", extra_ctes=_split_ctes(True)),
)(_standardized)

_GM_CTES = """,
gm AS (SELECT Model, avg(y) AS m FROM spl WHERE split = 'train' GROUP BY Model),
om AS (SELECT avg(y) AS m FROM spl WHERE split = 'train'),
pred AS (SELECT s.*, coalesce(gm.m, om.m) AS yhat FROM spl s LEFT JOIN gm USING (Model), om WHERE s.split = 'test')"""


def _reg_metrics(spark, d):
    s = _split(spark, d, False)
    scored = LN.group_mean_predictions(s.where("split = 'train'"), s.where("split = 'test'"), SPEC.model, "y")
    m = LN.regression_metrics(scored, "y", "yhat")
    return m.select(*[F.round(c, 9).alias(c) for c in ("r2", "rmse", "mae")], "n")


register(
    "regression_metrics_group_mean", "K7",
    with_sales("""
SELECT ROUND(1 - sum((y - yhat) * (y - yhat)) / (sum(y * y) - sum(y) * sum(y) / COUNT(*)), 9) AS r2,
       ROUND(sqrt(sum((y - yhat) * (y - yhat)) / COUNT(*)), 9) AS rmse,
       ROUND(sum(abs(y - yhat)) / COUNT(*), 9) AS mae, COUNT(*) AS n FROM pred""",
               extra_ctes=_split_ctes(False) + _GM_CTES),
)(_reg_metrics)


def _clf_metrics(spark, d):
    s = _split(spark, d, True)
    scored = LN.group_mean_predictions(s.where("split = 'train'"), s.where("split = 'test'"), SPEC.model, "label",
                                       out="score")
    m = LN.classification_metrics(scored, "label", "score")
    return m.select(*[F.round(c, 9).alias(c) for c in ("roc_auc", "accuracy", "f1")])


register(
    "classification_metrics_group_mean", "K8 E6",
    with_sales("""
SELECT ROUND(sum(p * (neg_below + q / 2.0)) / (sum(p) * sum(q)), 9) AS roc_auc,
       ROUND(max(acc), 9) AS accuracy, ROUND(max(f1), 9) AS f1
FROM (SELECT yhat, p, q, coalesce(SUM(q) OVER (ORDER BY yhat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS neg_below
      FROM (SELECT yhat, CAST(sum(label) AS DOUBLE) AS p, CAST(COUNT(*) - sum(label) AS DOUBLE) AS q
            FROM pred GROUP BY yhat) g) r,
     (SELECT avg(CASE WHEN (yhat >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS acc,
             coalesce(2.0 * sum(CASE WHEN yhat >= 0.5 AND label = 1 THEN 1 ELSE 0 END)
               / nullif(2.0 * sum(CASE WHEN yhat >= 0.5 AND label = 1 THEN 1 ELSE 0 END)
                        + sum(CASE WHEN yhat >= 0.5 AND label = 0 THEN 1 ELSE 0 END)
                        + sum(CASE WHEN yhat < 0.5 AND label = 1 THEN 1 ELSE 0 END), 0), 0.0) AS f1
      FROM pred) a""",
               extra_ctes=_split_ctes(True) + _GM_CTES.replace("avg(y)", "avg(CAST(label AS DOUBLE))")),
)(_clf_metrics)


def _conformal(spark, d):
    roles = LN.conformal_roles(_labelled(spark, d), "row_key", seed=SEED, split=_split(spark, d, False))
    scored = LN.group_mean_predictions(roles.where("role = 'fit'"), roles.where("role <> 'fit'"), SPEC.model, "y")
    out = LN.split_conformal(scored, "y", "yhat", "role", alpha=0.1)
    return out.select("alpha", *[F.round(c, 9).alias(c) for c in
                                 ("half_width", "coverage", "target_std", "target_range", "relative_width")],
                      "is_informative", "n_calibration")


register(
    "conformal_group_mean", "K11",
    with_sales("""
SELECT CAST(0.1 AS DOUBLE) AS alpha, ROUND(hw, 9) AS half_width,
       ROUND(avg(CASE WHEN abs(t.y - t.yhat) <= hw THEN 1.0 ELSE 0.0 END), 9) AS coverage,
       ROUND(stddev_pop(t.y), 9) AS target_std, ROUND(max(t.y) - min(t.y), 9) AS target_range,
       ROUND(2 * hw / (max(t.y) - min(t.y)), 9) AS relative_width,
       2 * hw / (max(t.y) - min(t.y)) < 0.6 AS is_informative, max(ncal) AS n_calibration
FROM (SELECT p.*, coalesce(gm.m, om.m) AS yhat FROM roles p LEFT JOIN gm USING (Model), om WHERE p.role = 'test') t,
     (SELECT max(v_lo) + (max(pos) - floor(max(pos))) * (max(v_hi) - max(v_lo)) AS hw, max(ncal) AS ncal
      FROM (SELECT CASE WHEN rn - 1 = floor(pos) THEN sc END AS v_lo, CASE WHEN rn - 1 = ceil(pos) THEN sc END AS v_hi,
                   pos, ncal
            FROM (SELECT sc, row_number() OVER (ORDER BY sc) AS rn, COUNT(*) OVER () AS ncal,
                         least(ceil((COUNT(*) OVER () + 1) * CAST(0.9 AS DOUBLE)) / COUNT(*) OVER (), 1.0)
                           * (COUNT(*) OVER () - 1) AS pos
                  FROM (SELECT abs(c.y - coalesce(gm.m, om.m)) AS sc FROM roles c LEFT JOIN gm USING (Model), om
                        WHERE c.role = 'cal') x) y) z) q
GROUP BY hw""",
               extra_ctes=_split_ctes(False) + """,
tr AS (SELECT *, row_number() OVER (ORDER BY md5(row_key || ':42:cal')) AS rn2, COUNT(*) OVER () AS ntr
       FROM spl WHERE split = 'train'),
roles AS (SELECT row_key, Model, y, CASE WHEN rn2 <= ntr // 2 THEN 'fit' ELSE 'cal' END AS role FROM tr
          UNION ALL SELECT row_key, Model, y, 'test' FROM spl WHERE split = 'test'),
gm AS (SELECT Model, avg(y) AS m FROM roles WHERE role = 'fit' GROUP BY Model),
om AS (SELECT avg(y) AS m FROM roles WHERE role = 'fit')"""),
)(_conformal)

ALPHAS = (0.05, 0.1, 0.2)


def _conformal_boosted(spark, d):
    """K11 on a boosted fit, for the given and the signal-bearing target: all alphas from one scored table."""
    parts = []
    for name, target in (("given", None), ("synthetic", "synthetic_demand")):
        scored = TR.conformal_scores(_training_table(spark, d, target), seed=SEED)
        parts.append(LN.split_conformal(scored, "label", "score", "role", alpha=ALPHAS).withColumn("target", F.lit(name)))
    out = parts[0].unionByName(parts[1])
    return out.select("target", "alpha", *[F.round(c, 6).alias(c) for c in ("half_width", "coverage", "relative_width")], "is_informative", "n_calibration")


register("conformal_boosted", "K11")(_conformal_boosted)

FOLD_SQL = f"CAST(least(floor({hash_uniform_sql(chr(39).join(['row_key || ', ':42:fold', '']))} * 5), 4) AS INT)"


def _kfold(spark, d):
    s = _split(spark, d, False).where("split = 'train'")
    out = LN.kfold_group_mean(s, "row_key", SPEC.model, "y", k=5, seed=SEED)
    return out.select("fold", F.round("r2", 9).alias("r2"), "n")


_KFOLD_CTES = _split_ctes(False) + f""",
tr AS (SELECT Model, y, {FOLD_SQL} AS fold FROM spl WHERE split = 'train'),
gf AS (SELECT Model, fold, sum(y) AS s_gf, COUNT(*) AS n_gf FROM tr GROUP BY Model, fold),
g AS (SELECT Model, sum(s_gf) AS s_g, sum(n_gf) AS n_g FROM gf GROUP BY Model),
fo AS (SELECT fold, sum(s_gf) AS s_f, sum(n_gf) AS n_f FROM gf GROUP BY fold),
al AS (SELECT sum(s_gf) AS s_a, sum(n_gf) AS n_a FROM gf),
pr AS (SELECT gf.Model, gf.fold,
              coalesce((g.s_g - gf.s_gf) / nullif(CAST(g.n_g - gf.n_gf AS DOUBLE), 0),
                       (al.s_a - fo.s_f) / (al.n_a - fo.n_f)) AS yhat
       FROM gf JOIN g USING (Model) JOIN fo USING (fold), al),
folds AS (SELECT fold, 1 - sum((y - yhat) * (y - yhat)) / (sum(y * y) - sum(y) * sum(y) / COUNT(*)) AS r2,
                 COUNT(*) AS n
          FROM tr JOIN pr USING (Model, fold) GROUP BY fold)"""

register("kfold_group_mean", "K12", with_sales("SELECT fold, ROUND(r2, 9) AS r2, n FROM folds",
                                               extra_ctes=_KFOLD_CTES))(_kfold)
register("cv_summary_group_mean", "K12",
         with_sales("SELECT ROUND(avg(r2), 9) AS cv_mean, ROUND(stddev_pop(r2), 9) AS cv_std, COUNT(*) AS k FROM folds",
                    extra_ctes=_KFOLD_CTES))(
    lambda spark, d: LN.cv_summary(_kfold(spark, d)).select(
        F.round("cv_mean", 9).alias("cv_mean"), F.round("cv_std", 9).alias("cv_std"), "k")
)

SIZES = (0.1, 0.325, 0.55, 0.775, 1.0)


def _lcurve(spark, d):
    s = _split(spark, d, False).where("split = 'train'")
    out = LN.learning_curve_group_mean(s, "row_key", SPEC.model, "y", k=3, seed=SEED, fractions=SIZES)
    return out.select("size", F.round("r2_mean", 9).alias("r2_mean"), F.round("n_train_mean", 6).alias("n_train_mean"))


_FOLD3 = f"CAST(least(floor({hash_uniform_sql(chr(39).join(['row_key || ', ':42:fold', '']))} * 3), 2) AS INT)"
_USIZE = hash_uniform_sql("row_key || ':42:size'")
register(
    "learning_curve_group_mean", "K13",
    with_sales("""
SELECT size, ROUND(avg(r2), 9) AS r2_mean, ROUND(avg(n_train), 6) AS n_train_mean FROM (
  SELECT t.size, t.fold, 1 - sum((t.y - coalesce(st.s / st.n, ov.m)) * (t.y - coalesce(st.s / st.n, ov.m)))
           / (sum(t.y * t.y) - sum(t.y) * sum(t.y) / COUNT(*)) AS r2, max(ov.n_train) AS n_train
  FROM (SELECT tr.*, sz.size FROM tr, sz) t
  LEFT JOIN st ON st.size = t.size AND st.tfold = t.fold AND st.Model = t.Model
  JOIN ov ON ov.size = t.size AND ov.tfold = t.fold
  GROUP BY t.size, t.fold) x GROUP BY size""",
               extra_ctes=_split_ctes(False) + f""",
tr AS (SELECT Model, y, {_FOLD3} AS fold, {_USIZE} AS u FROM spl WHERE split = 'train'),
sz AS (SELECT unnest([{', '.join(f'CAST({s} AS DOUBLE)' for s in SIZES)}]) AS size),
fl AS (SELECT unnest([0, 1, 2]) AS tfold),
ct AS (SELECT tr.Model, tr.y, sz.size, fl.tfold FROM tr, sz, fl WHERE fl.tfold <> tr.fold AND tr.u < sz.size),
st AS (SELECT size, tfold, Model, sum(y) AS s, COUNT(*) AS n FROM ct GROUP BY size, tfold, Model),
ov AS (SELECT size, tfold, sum(y) / COUNT(*) AS m, CAST(COUNT(*) AS DOUBLE) AS n_train FROM ct GROUP BY size, tfold)"""),
)(_lcurve)

N_PERM = 30


def _perm(spark, d):
    s = _split(spark, d, False)
    out = LN.permutation_test_group_mean(s, "row_key", SPEC.model, "y", n_perm=N_PERM, seed=SEED)
    return out.select("perm", F.round("r2", 9).alias("r2"))


_PERM_CTES = _split_ctes(False) + f""",
tr AS (SELECT row_key, Model, y FROM spl WHERE split = 'train'),
te AS (SELECT Model, y FROM spl WHERE split = 'test'),
base AS (SELECT y, CAST(row_number() OVER (ORDER BY md5(row_key || ':0')) - 1 AS HUGEINT) AS j FROM tr),
size AS (SELECT CAST(COUNT(*) AS HUGEINT) AS n FROM tr),
pm AS (WITH RECURSIVE r(perm, a) AS (
         SELECT 1, (SELECT CAST({LN.PERM_PRIME} AS HUGEINT) % n FROM size)
         UNION ALL SELECT perm + 1, (a * (SELECT CAST({LN.PERM_PRIME} AS HUGEINT) % n FROM size)) % (SELECT n FROM size)
         FROM r WHERE perm < {N_PERM})
       SELECT perm, a, (perm * {LN.PERM_SHIFT}) % (SELECT n FROM size) AS b FROM r),
places AS (SELECT Model, SUM(k) OVER (ORDER BY Model) - k AS lo, SUM(k) OVER (ORDER BY Model) AS hi
           FROM (SELECT Model, COUNT(*) AS k FROM tr GROUP BY Model) c),
sh AS (SELECT pm.perm, base.y, (pm.a * base.j + pm.b) % (SELECT n FROM size) AS place FROM base, pm),
alltr AS (SELECT 0 AS perm, Model, y FROM tr
          UNION ALL SELECT sh.perm, places.Model, sh.y FROM sh JOIN places ON sh.place >= places.lo AND sh.place < places.hi),
gm AS (SELECT perm, Model, avg(y) AS m FROM alltr GROUP BY perm, Model),
om AS (SELECT perm, avg(y) AS m FROM alltr GROUP BY perm),
scores AS (
  SELECT p.perm, 1 - sum((te.y - coalesce(gm.m, om.m)) * (te.y - coalesce(gm.m, om.m)))
           / (sum(te.y * te.y) - sum(te.y) * sum(te.y) / COUNT(*)) AS r2
  FROM te CROSS JOIN (SELECT unnest(range(0, {N_PERM + 1})) AS perm) p
  LEFT JOIN gm ON gm.perm = p.perm AND gm.Model = te.Model JOIN om ON om.perm = p.perm
  GROUP BY p.perm)"""
register("permutation_scores_group_mean", "I9 E6",
         with_sales("SELECT CAST(perm AS INT) AS perm, ROUND(r2, 9) AS r2 FROM scores", extra_ctes=_PERM_CTES))(_perm)
def _perm_pvalue(spark, d):
    out = LN.permutation_pvalue(_perm(spark, d))
    return out.select(*[F.round(c, 9).alias(c) for c in ("observed", "null_mean", "null_std")],
                      "n_permutations", F.round("p_value", 9).alias("p_value"), "has_signal")


register(
    "permutation_pvalue_group_mean", "I9",
    with_sales("""
SELECT ROUND(o.r2, 9) AS observed, ROUND(avg(n.r2), 9) AS null_mean, ROUND(stddev_pop(n.r2), 9) AS null_std,
       COUNT(*) AS n_permutations,
       ROUND((sum(CASE WHEN n.r2 >= o.r2 THEN 1 ELSE 0 END) + 1) / (COUNT(*) + 1.0), 9) AS p_value,
       (sum(CASE WHEN n.r2 >= o.r2 THEN 1 ELSE 0 END) + 1) / (COUNT(*) + 1.0) < 0.05 AS has_signal
FROM (SELECT perm, ROUND(r2, 9) AS r2 FROM scores) n,
     (SELECT ROUND(r2, 9) AS r2 FROM scores WHERE perm = 0) o
WHERE n.perm > 0 GROUP BY o.r2""", extra_ctes=_PERM_CTES),
)(_perm_pvalue)


def _perm_auc(spark, d):
    out = LN.permutation_auc_group_mean(_split(spark, d, True), "row_key", SPEC.model, "label", n_perm=N_PERM, seed=SEED)
    return out.select("perm", F.round("roc_auc", 9).alias("roc_auc"))


_PERM_AUC_CTES = (
    _split_ctes(True) + _PERM_CTES[len(_split_ctes(False)) :].replace("Model, y FROM spl", "Model, CAST(label AS DOUBLE) AS y FROM spl")
).split(",\nscores AS (")[0] + """,
tg AS (SELECT Model, sum(y) AS p, COUNT(*) - sum(y) AS q FROM te GROUP BY Model),
sc AS (SELECT om.perm, coalesce(gm.m, om.m) AS s, sum(tg.p) AS p, sum(tg.q) AS q
       FROM tg CROSS JOIN om LEFT JOIN gm ON gm.perm = om.perm AND gm.Model = tg.Model GROUP BY 1, 2),
scores AS (SELECT perm, sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) AS roc_auc
           FROM (SELECT *, coalesce(SUM(q) OVER (PARTITION BY perm ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc) x GROUP BY perm)"""
register("permutation_auc_group_mean", "I9 E6",
         with_sales("SELECT CAST(perm AS INT) AS perm, ROUND(roc_auc, 9) AS roc_auc FROM scores", extra_ctes=_PERM_AUC_CTES))(_perm_auc)


# -- learners -------------------------------------------------------------------------------
def _enriched(spark, d):
    f = facts(spark, d)
    panel, fuel, _ = PN.build_external_panel(f, SPEC)
    return PN.enrich(f, SPEC, panel, fuel)


_TABLES: dict = {}


def _training_table(spark, d, target: str | None = None) -> TR.TrainingTable:
    """The encoded table of the enriched facts (or, with ``target``, of the signal-bearing ones), written once per application."""
    key = (spark.sparkContext.applicationId, d, facts_signature(spark, d), target)
    if key not in _TABLES:
        source = AU.signal_bearing_target(facts(spark, d), SPEC) if target else _enriched(spark, d)
        _TABLES[key] = TR.training_table(source, SPEC, target=target, seed=SEED)
    return _TABLES[key]


def _benchmark(spark, d):
    """All families of all tasks, each found by its random search (K5; the leakage run has none) at the operators' own sizes (400 rounds, 400 trees)."""
    return TR.benchmark(_enriched(spark, d), SPEC, tune=True, seed=SEED, table=_training_table(spark, d))


register("model_benchmark", "K3 K4 K6 K9 K10 G2 A14 A15")(lambda spark, d: _benchmark_cached(spark, d))
register("best_model_per_task", "F5 K6")(lambda spark, d: LN.best_models(_benchmark_cached(spark, d)))


def _search(spark, d, task: str):
    """K5: a random search of every family of a task: all draws and folds, and the chosen draw."""
    table = _training_table(spark, d)
    rows = []
    for name in TR.FAMILIES[task]:
        seek = TR.search_trees if name in TR.TREE_FAMILIES else TR.search_linear
        _, scores = seek(table, task, name, seed=SEED)
        best = TR.best_draw(scores)
        rows += [(task, name, draw, fold, None if value == float("-inf") else value, draw == best) for draw, fold, value in scores]
    return spark.createDataFrame(rows, "task string, model string, draw int, fold int, value double, chosen boolean")


register("model_search_regression", "K5")(lambda spark, d: _search(spark, d, "regression"))
register("model_search_classification", "K5")(lambda spark, d: _search(spark, d, "classification"))


def _tuned(spark, d):
    table = _training_table(spark, d)
    _, _, scored = TR.fit_family(table, "regression", "Linear", tune=True, seed=SEED)
    m = LN.regression_metrics(scored, "label", "score").first()
    return spark.createDataFrame([("regression", "Linear", k, float(m[k])) for k in ("r2", "rmse", "mae")],
                                 "task string, model string, metric string, value double")


register("tuned_search_linear", "K5")(_tuned)


def _mlp(spark, d):
    frame, num, cat = LN.model_frame(facts(spark, d), SPEC, "classification")
    split = LN.assign_split(frame, SPEC.key, seed=SEED, stratify="label")
    _, m = LN.mlp_classifier(split.where("split = 'train'"), split.where("split = 'test'"), num, cat, seed=SEED)
    return spark.createDataFrame([("classification", "MLP", k, float(v)) for k, v in m.items()],
                                 "task string, model string, metric string, value double")


register("mlp_classifier_metrics", "K16")(_mlp)


def _control(spark, d):
    return TR.positive_control(_training_table(spark, d), _training_table(spark, d, "synthetic_demand"), seed=SEED)


register("positive_control", "I11 I10")(_control)


CAPABILITY_TERMS = [f"C({SPEC.region})", "is_premium_tier", SPEC.engine, SPEC.year, SPEC.price, "is_electrified"]


def _capability(spark, d):
    """Can a full-feature learner find what is there? On the target built to be learnable:
    cross-validation and learning curve of the linear fit, all from one pass of Gram partials,
    its held-out R², the attribution of its parts, and the verdict."""
    built = AU.signal_bearing_target(facts(spark, d), SPEC)
    split = write_shared(LN.assign_split(built.withColumn("y", F.col("synthetic_demand")), "row_key", seed=SEED), "capability")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    fit = RG.ols_hc3(train, "y", CAPABILITY_TERMS, name="capability")
    design = RG.build_design(train, "y", CAPABILITY_TERMS)
    yhat = F.lit(0.0)
    for b, c in zip(fit.coef, design.columns, strict=True):
        yhat = yhat + F.lit(float(b)) * c
    held = LN.regression_metrics(test.withColumn("yhat", yhat), "y", "yhat").first()
    folds, curve = RG.linear_folds(train, "row_key", "y", CAPABILITY_TERMS, k=5, sizes=SIZES, seed=SEED)
    scores = [r2 for _, r2, _ in folds]
    mean = sum(scores) / len(scores)
    rows = [("linear_cv_mean", mean), ("linear_cv_std", (sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5), ("linear_train_r2", fit.r2), ("linear_test_r2", held["r2"])]
    rows += [(f"linear_learning_curve_{size:.3f}", r2) for size, r2, _ in curve]
    rows += [(f"attribution_{r['feature']}", r["mean_abs_attribution"]) for r in RG.linear_attribution(test, "y", CAPABILITY_TERMS, fit).collect()]
    rows.append(("is_skilful", 1.0 if held["r2"] > 0.5 and mean > 0.5 else 0.0))
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "metric string, value double")


register("capability_linear", "K14 K12 K13")(_capability)


def _capability_group_mean(spark, d):
    """K14 of the group-mean scorer on the same target: cross-validation and learning curve."""
    built = AU.signal_bearing_target(facts(spark, d), SPEC)
    train = write_shared(LN.assign_split(built.withColumn("y", F.col("synthetic_demand")), "row_key", seed=SEED), "capability").where("split = 'train'")
    cv = LN.cv_summary(LN.kfold_group_mean(train, "row_key", SPEC.model, "y", k=5)).first()
    rows = [("group_mean_cv_mean", cv["cv_mean"]), ("group_mean_cv_std", cv["cv_std"])]
    rows += [(f"group_mean_learning_curve_{r['size']:.3f}", r["r2_mean"]) for r in LN.learning_curve_group_mean(train, "row_key", SPEC.model, "y").orderBy("size").collect()]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "metric string, value double")


register("capability_group_mean", "K14 K12 K13")(_capability_group_mean)


def _kfold_price(spark, d):
    """K12 on a fitted learner that SQL can follow: log price on mileage, by fold."""
    from ledgerlens.operators.features import add_engineered_features

    data = add_engineered_features(facts(spark, d), SPEC)
    folds, _ = RG.linear_folds(data, "row_key", "log_price", [SPEC.mileage], k=5, seed=SEED)
    return spark.createDataFrame([(f, round(r2, 9), n) for f, r2, n in folds], "fold int, r2 double, n long")


register("kfold_linear_mileage", "K12 K14", with_sales("""
SELECT f.fold, ROUND(1 - sum((y - (o.my + o.b * (x - o.mx))) * (y - (o.my + o.b * (x - o.mx)))) / (var_pop(y) * COUNT(*)), 9) AS r2, COUNT(*) AS n
FROM t f JOIN (SELECT g.fold, avg(t.x) AS mx, avg(t.y) AS my, covar_pop(t.x, t.y) / var_pop(t.x) AS b
               FROM (SELECT DISTINCT fold FROM t) g JOIN t ON t.fold <> g.fold GROUP BY g.fold) o ON o.fold = f.fold
GROUP BY f.fold""", features=True, extra_ctes=f"t AS (SELECT log_price AS y, CAST(Mileage_KM AS DOUBLE) AS x, {FOLD_SQL} AS fold FROM feat)"))(_kfold_price)


def _importances(spark, d):
    """How much the held-out R² of a boosted fit falls when one column is moved by a bijection of the rows."""
    table = _training_table(spark, d, "synthetic_demand")
    model, _, _ = TR.fit_family(table, "regression", "Boosted", tune=False, seed=SEED)
    out = TR.permutation_importance(table.part("regression", "test"), model.predictor(), table.columns("regression"), seed=SEED)
    return out.select("feature", F.round("importance", 9).alias("importance"), F.round("importance_std", 9).alias("importance_std"))


register("feature_importances_synthetic", "K15")(_importances)


def _signal_audit(spark, d):
    f = facts(spark, d)
    perm = LN.permutation_pvalue(_perm(spark, d)).first()
    ks = AU.ks_uniform(f, list(SPEC.numeric)).collect()
    chi = AU.chi2_pairs(f, [(SPEC.model, SPEC.region), (SPEC.fuel, SPEC.transmission), (SPEC.region, SPEC.color)]).collect()
    rows = [("permutation (R2, group-mean scorer)", "SIGNAL" if perm["has_signal"] else "NO SIGNAL",
             f"observed={perm['observed']:+.4f}, null={perm['null_mean']:+.4f} +/- {perm['null_std']:.4f}, "
             f"p={perm['p_value']:.3f}")]
    auc = LN.permutation_pvalue(_perm_auc(spark, d).withColumnRenamed("roc_auc", "r2")).first()
    rows.append(("permutation (ROC-AUC, group-mean scorer)", "SIGNAL" if auc["has_signal"] else "NO SIGNAL",
                 f"observed={auc['observed']:+.4f}, null={auc['null_mean']:+.4f} +/- {auc['null_std']:.4f}, p={auc['p_value']:.3f}"))
    control = _control(spark, d).first()
    rows.append(("positive control", "VALIDATED" if control["pipeline_validated"] else "NOT VALIDATED", control["verdict"]))
    rows += [(f"KS uniform {r['feature']}", "uniform" if r["p_value"] > 0.05 else "not uniform",
              f"D={r['d_stat']:.4f}, p={r['p_value']:.3f}") for r in ks]
    rows += [(f"chi2 {r['feature_a']} vs {r['feature_b']}", "independent" if r["p_value"] > 0.05 else "dependent",
              f"chi2={r['chi2']:.3f}, dof={r['dof']}, p={r['p_value']:.3f}") for r in chi]
    return spark.createDataFrame(rows, "check string, verdict string, detail string")


register("signal_audit", "I13 I7 I8 I9")(_signal_audit)


# -- sinks (rows-only) -----------------------------------------------------------------------
_BENCH_CACHE: dict = {}


def _benchmark_cached(spark, d):
    """The benchmark table is small (task × model × metric); keep its rows per session."""
    key = (spark.sparkContext.applicationId, d, facts_signature(spark, d))
    if key not in _BENCH_CACHE:
        _BENCH_CACHE[key] = [tuple(r) for r in _benchmark(spark, d).collect()]
    return spark.createDataFrame(_BENCH_CACHE[key], "task string, model string, metric string, value double")


def _closed_metrics(spark, d):
    """(task, model, metric, value) of the group-mean and the constant scorer: a metrics table that SQL can make too."""
    rows = []
    for task, target in (("regression", "y"), ("classification", "label")):
        s = _split(spark, d, task == "classification")
        train, test = s.where("split = 'train'"), s.where("split = 'test'")
        for model, group in (("GroupMean", SPEC.model), ("Constant", "split")):
            scored = LN.group_mean_predictions(train, test, group, target, out="score")
            found = LN.regression_metrics(scored, target, "score").select(F.lit(task).alias("task"), F.lit(model).alias("model"), F.explode(F.array(*[
                F.struct(F.lit(c).alias("metric"), F.round(c, 9).alias("value")) for c in ("r2", "rmse", "mae")])).alias("x")).select("task", "model", "x.*")
            rows.append(found)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return write_shared(out, "closed-metrics")


def _closed_sql(select: str) -> str:
    parts, ctes = [], []
    for task, target, k in (("regression", "y", ""), ("classification", "CAST(label AS DOUBLE)", "2")):
        base = _split_ctes(task == "classification")
        for name in ("lab", "rk", "spl"):
            base = base.replace(f"{name} AS (", f"{name}{k} AS (").replace(f"FROM {name}\n", f"FROM {name}{k}\n").replace(f"FROM {name})", f"FROM {name}{k})")
        ctes.append(base)
        for model, means in (("GroupMean", f"(SELECT Model AS g, avg({target}) AS m FROM spl{k} WHERE split = 'train' GROUP BY Model)"), ("Constant", "(SELECT NULL AS g, NULL AS m)")):
            scored = f"""(SELECT {target} AS y, coalesce(gm.m, om.m) AS p FROM spl{k} s LEFT JOIN {means} gm ON gm.g = s.Model,
                (SELECT avg({target}) AS m FROM spl{k} WHERE split = 'train') om WHERE s.split = 'test')"""
            parts += [f"SELECT '{task}' AS task, '{model}' AS model, '{metric}' AS metric, ROUND({value}, 9) AS value FROM {scored}" for metric, value in (
                ("r2", "1 - sum((y - p) * (y - p)) / (var_pop(y) * COUNT(*))"), ("rmse", "sqrt(sum((y - p) * (y - p)) / COUNT(*))"), ("mae", "avg(abs(y - p))"))]
    return with_sales(select, extra_ctes=",\n".join(ctes) + ",\nclosed AS (" + " UNION ALL ".join(parts) + ")")


def _metrics_roundtrip(spark, d):
    """The metrics table written as JSON lines, read back with its schema, and the best model of each task."""
    from ledgerlens.sources import sinks as SK

    path = SK.default_root(spark, "metrics")
    SK.write_metrics(_closed_metrics(spark, d), path)
    back = SK.read_metrics(spark, path).where("metric = 'r2'")
    return back.groupBy("task").agg(F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best_model"), F.max("value").alias("best_value"))


register("metrics_sink_roundtrip", "A12 A13 F5", _closed_sql(
    "SELECT task, arg_min(model, (-value, model)) AS best_model, max(value) AS best_value FROM closed WHERE metric = 'r2' GROUP BY task"))(_metrics_roundtrip)


def _metrics_nested(spark, d):
    """One JSON document a task, written as text, read back and taken apart again."""
    from ledgerlens.sources import sinks as SK

    path = SK.default_root(spark, "metrics-nested")
    SK.nested_metrics(_closed_metrics(spark, d)).select("json").write.mode("overwrite").text(path)
    docs = spark.read.text(path).select(F.from_json("value", "map<string, map<string, map<string, double>>>").alias("x"))
    models = docs.select(F.explode("x").alias("task", "models")).select("task", F.explode("models").alias("model", "metrics"))
    return models.select("task", "model", F.explode("metrics").alias("metric", "value"))


register("metrics_nested_json", "A12 G2", _closed_sql("SELECT task, model, metric, value FROM closed"))(_metrics_nested)


def _artefacts(spark, d):
    """The benchmark's saved models are reused only with their own feature list, its
    runs are read back from the log, and the report sections are written as tables."""
    import os

    from ledgerlens.sources import sinks as SK

    metrics = _benchmark_cached(spark, d)
    table = _training_table(spark, d)
    root = TR.benchmark_root(spark)
    features = table.features("regression")
    linear, boosted = (os.path.join(root, "regression", name) for name in ("Linear", "Boosted"))
    reused = SK.load_model_if_compatible(spark, linear, features)
    refused = SK.load_model_if_compatible(spark, linear, features[:-1])
    loaded = TR.Committee.load(spark, boosted)
    again = LN.regression_metrics(loaded.score(table.part("regression", "test")), "label", "score").first()["r2"]
    saved = metrics.where("task = 'regression' and model = 'Boosted' and metric = 'r2'").first()["value"]
    logged = TR.logged_metrics(spark, root)
    written = SK.write_report_tables({"metrics": metrics, "best": LN.best_models(metrics), "runs": logged}, os.path.join(root, "report"))
    same = logged.join(metrics.withColumnRenamed("value", "told"), ["task", "model", "metric"]).where("value = told").count()
    return spark.createDataFrame(
        [("model_reused_when_features_match", float(reused is not None)), ("model_refused_when_features_differ", float(refused is None)),
         ("loaded_model_scores_the_same", float(abs(again - saved) < 1e-12)), ("logged_metrics", float(logged.count())), ("logged_metrics_as_told", float(same)),
         ("report_rows", float(sum(spark.read.parquet(path).count() for path in written.values())))],
        "item string, value double")


register("model_artefacts_and_run_log", "A14 A15 A16 K2")(_artefacts)
