"""The training table, tree committees, search, importance, conformal and fold fits, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import audit as AU
from ledgerlens.operators import learn as LN
from ledgerlens.operators import regress as RG
from ledgerlens.operators import training as TR
from ledgerlens.operators.trees import fit_trees, predict_trees


@pytest.fixture(scope="module")
def table(sample_sales, spec):
    return TR.training_table(sample_sales, spec)


@pytest.fixture(scope="module")
def planted(sample_sales, spec):
    return TR.training_table(AU.signal_bearing_target(sample_sales, spec), spec, target="synthetic_demand")


def test_one_stump_is_the_best_split():
    """A tree of depth one against a search over every edge."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 3)).astype("f8")
    y = (x[:, 1] > 4) * 3.0 + rng.normal(size=300) * 0.1
    member = fit_trees(x, y, 3, kind="boosted", task="regression", rounds=1, depth=1, rate=1.0, min_rows=1)
    got = predict_trees(member, x)
    g = y - y.mean()
    best = max(((g[x[:, j] <= t].sum() ** 2 / ((x[:, j] <= t).sum() + 1) + g[x[:, j] > t].sum() ** 2 / ((x[:, j] > t).sum() + 1), j, t)
                for j in range(3) for t in range(8)))
    left = x[:, best[1]] <= best[2]
    for side in (left, ~left):
        assert got[side] == pytest.approx(y.mean() + g[side].sum() / (side.sum() + 1))


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_trees_learn_numbers_and_categories(kind):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(3000, 2)), rng.integers(0, 12, 3000)])
    y = 2 * x[:, 0] + 3 * (x[:, 2] % 3) + rng.normal(size=3000) * 0.3
    sizes = {"rounds": 150, "depth": 5, "min_rows": 5.0} | ({"rate": 0.1} if kind == "boosted" else {})
    member = fit_trees(x[:2000], y[:2000], 2, kind=kind, task="regression", seed=1, **sizes)
    assert member == fit_trees(x[:2000], y[:2000], 2, kind=kind, task="regression", seed=1, **sizes)
    e = y[2000:] - predict_trees(member, x[2000:])
    assert 1 - e.var() / y[2000:].var() > (0.95 if kind == "boosted" else 0.8)
    strange = predict_trees(member, np.array([[0.0, 0.0, 99.0], [math.inf, -math.inf, -1.0]]))  # unknown levels, any number
    assert np.isfinite(strange).all()
    label = (y > y.mean()).astype("f8")
    p = predict_trees(fit_trees(x[:2000], label[:2000], 2, kind=kind, task="classification", seed=1, **sizes), x[2000:])
    assert ((p >= 0) & (p <= 1)).all() and ((p > 0.5) == label[2000:]).mean() > 0.9


def test_trees_of_few_or_equal_rows():
    one = fit_trees(np.array([[1.0, 0.0]]), np.array([5.0]), 1, kind="boosted", task="regression", rounds=3, depth=2)
    assert predict_trees(one, np.array([[7.0, 3.0]])) == pytest.approx([5.0])
    same = fit_trees(np.zeros((40, 2)), np.ones(40), 1, kind="forest", task="classification", rounds=3, depth=2)
    assert predict_trees(same, np.zeros((2, 2))) == pytest.approx([1.0, 1.0])


def test_training_table_is_written_once_and_whole(sample_sales, spec, table):
    assert table.n_rows == sample_sales.count() == table.rows.count()
    plan = table.part("classification", "train")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert "Sales_Volume" not in table.features("classification") and "Sales_Volume" in table.features("classification_leaked")
    sizes = {r["split_clf"]: r["n"] for r in table.rows.groupBy("split_clf").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(sizes["test"] / table.n_rows - 0.15) < 0.01


def test_only_what_is_read_again_stays_written(spark, sample_sales, spec):
    """The table's own input and the codes of a selection go once they are used; what stays is packed, a column for each feature."""
    import os

    import pyarrow.parquet as pq

    from ledgerlens.session import checkpoint_dir

    stage = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "ledgerlens-stage")
    before = set(os.listdir(stage)) if os.path.isdir(stage) else set()
    made = TR.training_table(sample_sales, spec)
    assert made.part("regression", "train").count() + made.part("regression", ["val", "test"]).count() == made.n_rows
    new = sorted(set(os.listdir(stage)) - before)
    assert {name.split("-")[0] for name in new} == {"select", "learn"} and [name.startswith("learn-table") for name in new].count(True) == 1
    folder = os.path.join(stage, next(name for name in new if name.startswith("learn-table")))
    parts = [pq.ParquetFile(os.path.join(folder, f)).metadata for f in os.listdir(folder) if f.endswith(".parquet")]
    assert {m.row_group(0).column(0).compression for m in parts if m.num_row_groups} == {"ZSTD"}
    assert all(m.num_columns == 6 + len(made.numeric) + len(made.categorical) for m in parts)


def test_vectors_of_linear_models_are_made_from_the_stored_numbers(table):
    """They are not written with the table, and a tree's reader doesn't make them."""
    assert "linear" not in table.rows.columns and "linear_leaked" not in table.rows.columns
    plan = table.part("regression", "train").select("label", "x")._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan
    for task in ("regression", "classification_leaked"):
        rows = table.part(task, ["train", "test"]).orderBy("row_key").limit(200).collect()
        got, x = np.array([r["linear"].toArray() for r in rows]), np.array([r["x"] for r in rows])
        leaked = int(task.endswith("leaked"))
        scaler = next(s for s in table.encoder.stages if hasattr(s, "std"))
        k = len(table.numeric)
        spread = scaler.std.toArray()
        assert got[:, :k] == pytest.approx((x[:, :k] - scaler.mean.toArray()) * np.divide(1.0, spread, out=np.zeros(k), where=spread > 0))
        assert (got[:, k:got.shape[1] - leaked].sum(axis=1) <= len(table.categorical)).all() and set(np.unique(got[:, k:got.shape[1] - leaked])) == {0.0, 1.0}
        if leaked:
            assert (got[:, -1] == x[:, k]).all()


def test_every_training_row_is_fitted_beyond_the_most_members(planted, monkeypatch):
    monkeypatch.setattr(TR, "SHARD_ROWS", 20)
    monkeypatch.setattr(TR, "FEW_MEMBERS", 1)
    monkeypatch.setattr(TR, "WIDE_SHARD_ROWS", 100)
    monkeypatch.setattr(TR, "MAX_MEMBERS", 3)
    shards = TR.packed_shards(planted, "regression", name="whole")
    assert shards.count() == 3 and shards.agg(F.sum("n")).first()[0] == planted.part("regression", "train").count()


def test_leak_is_learned_and_honest_features_are_not(sample_sales, spec, table):
    found = {}
    for task in ("classification", "classification_leaked"):
        for name in TR.FAMILIES[task]:
            _, _, scored = TR.fit_family(table, task, name, tune=False, rounds=20, trees=20)
            found[task, name] = TR.metrics_of(scored, task).first()["roc_auc"]
    assert all(v > 0.95 for (t, _), v in found.items() if t.endswith("leaked"))
    assert all(v < 0.65 for (t, _), v in found.items() if not t.endswith("leaked"))


def test_positive_control_finds_the_planted_signal(table, planted):
    r = TR.positive_control(table, planted, rounds=60).first()
    assert r.pipeline_validated and r.r2_synthetic > 0.5 and r.r2_real < 0.1


def test_search_covers_every_draw_and_fold(planted):
    params, rows = TR.search_trees(planted, "regression", "Boosted", draws=3, folds=3, rounds=15)
    assert [(d, f) for d, f, _ in rows] == [(d, f) for d in range(3) for f in range(3)]
    mean = [np.mean([v for d, _, v in rows if d == i]) for i in range(3)]
    assert TR.best_draw(rows) == int(np.argmax(mean)) and params in TR.tree_draws("Boosted", 3, TR.SEED, 15, TR.TREES)
    # a fold's score is that of a fit without it
    shards = TR.packed_shards(planted, "regression")
    draw = TR.tree_draws("Boosted", 3, TR.SEED, 15, TR.TREES)[0]
    model = TR.Committee.of(TR.fit_committees(shards, [(draw, 0)], "regression", planted.n_numeric("regression")), 0)
    alone = TR.metrics_of(model.score(planted.part("regression", "train").where("fold = 0")), "regression").first()["r2"]
    assert rows[0][2] == pytest.approx(alone)


def test_committee_is_the_mean_of_its_shards(planted, monkeypatch):
    monkeypatch.setattr(TR, "SHARD_ROWS", 400)
    shards = TR.packed_shards(planted, "regression", part=planted.part("regression", "train"), name="small")
    assert shards.count() > 1 and shards.agg(F.sum("n")).first()[0] == planted.part("regression", "train").count()
    model = TR.Committee.of(TR.fit_committees(shards, [(TR.tree_params("Boosted", 20, 20), None)], "regression", planted.n_numeric("regression")), 0)
    rows = planted.part("regression", "test").orderBy("row_key").limit(50).toPandas()
    x = np.stack(rows["x"].to_numpy())
    want = np.average([predict_trees(m, x) for m in model.members], axis=0, weights=[m["n_rows"] for m in model.members])
    got = model.score(planted.part("regression", "test")).where(F.col("row_key").isin(list(rows["row_key"]))).orderBy("row_key").toPandas()["score"]
    assert got.to_numpy() == pytest.approx(want)


def test_benchmark_saves_models_and_logs_runs(spark, sample_sales, spec, table, tmp_path):
    from ledgerlens.sources import sinks as SK

    root = str(tmp_path / "bench")
    metrics = TR.benchmark(sample_sales, spec, tune=False, rounds=10, trees=10, root=root, table=table)
    rows = {(r["task"], r["model"], r["metric"]): r["value"] for r in metrics.collect()}
    assert {(t, m) for t, m, _ in rows} == {(t, m) for t in TR.TASKS for m in TR.FAMILIES[t]}
    assert {(r["task"], r["model"], r["metric"]): r["value"] for r in TR.logged_metrics(spark, root).collect()} == {k: v for k, v in rows.items() if v is not None}
    path = f"{root}/regression/Boosted"
    assert SK.saved_features(spark, path) == table.features("regression") and SK.saved_features(spark, f"{root}/none") is None
    again = TR.Committee.load(spark, path).score(table.part("regression", "test"))
    assert TR.metrics_of(again, "regression").first()["r2"] == pytest.approx(rows["regression", "Boosted", "r2"])
    assert SK.load_model_if_compatible(spark, f"{root}/regression/Linear", table.features("regression")) is not None
    assert SK.load_model_if_compatible(spark, f"{root}/regression/Linear", ["other"]) is None
    best = {r["task"]: r["best_model"] for r in LN.best_models(metrics).collect()}
    assert set(best) == set(TR.TASKS)


def test_benchmark_query_searches_every_family(spark, sample_sales, spec, table, tmp_path, monkeypatch):
    """The registered job runs the six draws and three folds of every family but those of the leakage run."""
    from ledgerlens.plans import q_learn as QL

    searched, benchmark = [], TR.benchmark
    for kind in ("search_trees", "search_linear"):
        def seek(table, task, name, *, draws, own=getattr(TR, kind), **sizes):
            found = own(table, task, name, draws=draws, **sizes)
            searched.append((task, name, len(found[1])))
            return found

        monkeypatch.setattr(TR, kind, seek)
    monkeypatch.setattr(QL, "_enriched", lambda spark, d: sample_sales)
    monkeypatch.setattr(QL, "_training_table", lambda spark, d: table)
    monkeypatch.setattr(TR, "benchmark", lambda *a, **k: benchmark(*a, rounds=3, trees=3, root=str(tmp_path / "searched"), **k))
    found = {(r["task"], r["model"]) for r in QL._benchmark(spark, "").collect()}
    assert found == {(task, name) for task in TR.TASKS for name in TR.FAMILIES[task]}
    assert sorted(searched) == sorted((task, name, TR.DRAWS * TR.FOLDS) for task in TR.TASKS[:2] for name in TR.FAMILIES[task])


def test_best_models_pass_over_nulls(spark):
    rows = [("regression", "A", "r2", None), ("regression", "B", "r2", 0.1), ("regression", "C", "r2", 0.1)]
    kind = "task string, model string, metric string, value double"
    assert LN.best_models(spark.createDataFrame(rows, kind)).first()["best_model"] == "B"
    with pytest.raises(ValueError):
        LN.best_models(spark.createDataFrame(rows[:1], kind))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 100, 1009])
def test_keyed_places_are_bijections(spark, n):
    got = spark.range(n).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("key"), "id").select("key", "id", TR.keyed_place(F.col("id"), n, F.col("key")).alias("to")).toPandas()
    for _, part in got.groupby("key"):
        assert sorted(part["to"]) == list(range(n))
    if n > 100:
        a, b = (part.sort_values("id")["to"].to_numpy() for _, part in got.groupby("key"))
        # neither the identity, nor one another, nor shifts or multiples of one another
        assert (a != np.arange(n)).mean() > 0.9 and (a != b).mean() > 0.9 and len(set((a - b) % n)) > n / 4 and len(set(np.diff(a) % n)) > n / 4


def test_permutation_importance_of_a_linear_scorer(spark):
    """For a scorer b·x the fall of column j is known from the moved values."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1.0, 2.0, 1.0]
    y = 3 * x[:, 0] + x[:, 1] + rng.normal(size=400) * 0.1
    rows = spark.createDataFrame([(f"{i:04d}", float(y[i]), x[i].tolist()) for i in range(400)], "row_key string, label double, x array<double>").repartition(3)
    out = {r["feature"]: r for r in TR.permutation_importance(rows, lambda z: z @ np.array([3.0, 1.0, 0.0]), ["a", "b", "c"], replicas=8).collect()}
    share = [9 * x[:, 0].var() / y.var(), x[:, 1].var() / y.var()]  # twice the explained share is expected
    assert out["a"]["importance"] == pytest.approx(2 * share[0], rel=0.15) and out["b"]["importance"] == pytest.approx(2 * share[1], rel=0.2)
    assert out["c"]["importance"] == pytest.approx(0.0, abs=1e-12) and out["a"]["importance_std"] > 0


def test_importance_of_columns_that_no_tree_reads(planted, monkeypatch):
    """Columns without a split are neither sent nor scored, rows as they are only once; the falls are those of scoring all."""
    model, _, _ = TR.fit_family(planted, "regression", "Boosted", tune=False, rounds=5)
    test, columns, predict = planted.part("regression", "test"), planted.columns("regression"), model.predictor()
    assert 0 < len(predict.used) < len(columns)
    written, write = [], TR.write_shared
    monkeypatch.setattr(TR, "write_shared", lambda df, name="stage": written.append((name, write(df, name))) or written[-1][1])
    found = [{r["feature"]: (r["importance"], r["importance_std"]) for r in TR.permutation_importance(test, p, columns).collect()} for p in (predict, lambda x: predict(x))]
    assert found[0].keys() == found[1].keys() == set(columns)
    for feature in columns:
        assert found[0][feature] == pytest.approx(found[1][feature], abs=1e-12)
    few, every = (frame.count() for name, frame in written if name == "importance-sums")
    assert (few, every) == (TR.REPLICAS * len(predict.used) + 1, TR.REPLICAS * len(columns) + 1)


def test_conformal_is_tighter_on_the_planted_target(table, planted):
    for_target = {}
    for name, t in (("given", table), ("planted", planted)):
        rows = LN.split_conformal(TR.conformal_scores(t, rounds=60), "label", "score", "role", alpha=[0.05, 0.1, 0.2]).collect()
        for_target[name] = rows
        widths = [r["half_width"] for r in rows]
        assert widths == sorted(widths, reverse=True)
        for r in rows:
            assert abs(r["coverage"] - (1 - r["alpha"])) < 0.08 and r["n_calibration"] > 400
    assert for_target["planted"][1]["relative_width"] < 0.7 * for_target["given"][1]["relative_width"]
    assert for_target["planted"][1]["is_informative"]


def test_fold_fits_from_sums_equal_fits_of_rows(sample_sales, spec):
    data = AU.signal_bearing_target(sample_sales, spec)
    terms = [f"C({spec.region})", spec.engine, spec.price]
    folds, curve = RG.linear_folds(data, "row_key", "synthetic_demand", terms, k=4, sizes=(0.3, 1.0))
    pdf = data.select(LN._fold("row_key", 4, LN.SEED).alias("fold"), LN.hash_uniform(F.col("row_key"), LN.SEED, "size").alias("u"), spec.region, spec.engine, spec.price, "synthetic_demand").toPandas()
    levels = sorted(pdf[spec.region].unique())[1:]
    x = np.column_stack([np.ones(len(pdf)), *[(pdf[spec.region] == v).astype(float) for v in levels], pdf[spec.engine].astype(float), pdf[spec.price].astype(float)])
    y = pdf["synthetic_demand"].to_numpy()

    def r2(train, test):
        b = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
        return 1 - ((y[test] - x[test] @ b) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum()

    for f, got, n in folds:
        test = (pdf["fold"] == f).to_numpy()
        assert got == pytest.approx(r2(~test, test), rel=1e-8) and n == test.sum()
    for size, got, n in curve:
        train = (pdf["u"] < size).to_numpy()
        want = [(r2(train & (pdf["fold"] != f).to_numpy(), (pdf["fold"] == f).to_numpy()), (train & (pdf["fold"] != f)).sum()) for f in range(4)]
        assert got == pytest.approx(np.mean([w for w, _ in want]), rel=1e-8) and n == pytest.approx(np.mean([w for _, w in want]))
    assert np.mean([r for _, r, _ in folds]) > 0.5


def test_permutation_auc_of_a_signal_and_of_none(spark):
    rng = np.random.default_rng(8)
    rows = [(f"k{i}", f"g{g}", int(rng.random() < 0.2 + 0.2 * (g % 3)), int(rng.random() < 0.4)) for i in range(3000) for g in [int(rng.integers(0, 9))]]
    split = LN.assign_split(spark.createDataFrame(rows, "row_key string, grp string, label int, noise int"), "row_key")
    for label, signal in (("label", True), ("noise", False)):
        auc = {r["perm"]: r["roc_auc"] for r in LN.permutation_auc_group_mean(split, "row_key", "grp", label, n_perm=20).collect()}
        scored = LN.group_mean_predictions(split.where("split = 'train'"), split.where("split = 'test'"), "grp", label)
        assert auc[0] == pytest.approx(LN.roc_auc(scored, label, "yhat").first()["roc_auc"])
        assert len(auc) == 21 and (auc[0] > max(auc[p] for p in range(1, 21))) is signal


def test_mlp_runs(sample_sales, spec):
    frame, num, cat = LN.model_frame(sample_sales, spec, "classification")
    split = LN.assign_split(frame, spec.key, stratify="label")
    _, m = LN.mlp_classifier(split.where("split = 'train'"), split.where("split = 'test'"), num, cat, hidden=(8,), max_iter=5)
    assert 0 <= m["roc_auc"] <= 1


@pytest.mark.parametrize(("kind", "depth"), [("boosted", 3), ("boosted", 5), ("boosted", 6), ("forest", 8)])
def test_rows_reach_the_leaf_their_splits_lead_to(kind, depth):
    """Masks and joined columns against a walk of every row down every tree, unsplit nodes and unseen values included."""
    from ledgerlens.operators import trees as TS

    rng = np.random.default_rng(depth)
    region = rng.integers(0, 5, 700)
    x = np.column_stack([rng.normal(size=700), region * 1.5, region * -2.0 + (rng.random(700) < 0.1), rng.integers(0, 40, 700), region])
    y = (x[:, 0] > 1).astype("f8") + (region == 2)
    member = fit_trees(x[:500], y[:500], 4, kind=kind, task="regression", rounds=12, depth=depth, min_rows=5.0)
    binning = TS.Binning([np.array(e) for e in member["edges"]], [np.array(r, "i4") for r in member["ranks"]])
    nodes = (1 << depth + 1) - 1
    column, cut = (np.frombuffer(member[c], "<i2").reshape(-1, nodes) for c in ("column", "cut"))
    value = np.frombuffer(member["value"], "<f8").reshape(-1, nodes)
    assert (column[:, : nodes // 2] < 0).any() and (column[:, 0] >= 0).all()
    x[600:, 4] = 9.0
    want = []
    for row in binning(x):
        total = 0.0
        for c, b, v in zip(column, cut, value, strict=True):
            at = 0
            while at < nodes // 2:
                at = 2 * at + 1 + int(c[at] >= 0 and row[c[at]] > b[at])
            total += v[at]
        want.append(member["start"] + member["rate"] * total)
    assert predict_trees(member, x) == pytest.approx(want, rel=1e-12)


def test_joined_columns_give_each_row_its_bins():
    from ledgerlens.operators.trees import joined

    rng = np.random.default_rng(4)
    region = rng.integers(0, 6, 900)
    bins = np.stack([region, region % 3, rng.integers(0, 60, 900), 5 - region, rng.integers(0, 30, 900)]).astype("i4")
    groups = joined(bins, 64)
    assert len(groups) < len(bins) and sorted(c for columns, _, _ in groups for c in columns) == list(range(len(bins)))
    for columns, cell, values in groups:
        for c, v in zip(columns, values, strict=True):
            assert (v[cell] == bins[c]).all()


def test_members_grow_before_they_become_many(planted, monkeypatch):
    """Every row is scored by each member: eight shards at first, and more only beyond the wide ones' rows."""
    monkeypatch.setattr(TR, "SHARD_ROWS", 20)
    monkeypatch.setattr(TR, "WIDE_SHARD_ROWS", 500)
    shards = TR.packed_shards(planted, "regression", name="grown")
    assert shards.count() == TR.FEW_MEMBERS and shards.agg(F.sum("n")).first()[0] == planted.part("regression", "train").count()


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_linear_search_scores_are_those_of_each_fit(table, task):
    name = TR.FAMILIES[task][-1]
    found = TR.search_linear(table, task, name, draws=1)[1]
    train, base = table.part(task, "train"), TR.linear_estimator(task)
    maps = TR.random_params(base, name, 1, TR.SEED)
    for d, f, value in found:
        model = base.copy(maps[d]).fit(train.where(F.col("fold") != f))
        assert value == pytest.approx(TR._fold_scores(TR.linear_score(model, train.where(F.col("fold") == f), task), task), abs=1e-6)  # the solver stops at 1e-6


def test_only_the_lighter_siblings_rows_are_summed(monkeypatch):
    """Below the root at most half of the rows, and the sums are those of each node's own rows."""
    from ledgerlens.operators import trees as TS

    rng = np.random.default_rng(6)
    bins = np.stack([rng.integers(0, 30, 4000), rng.integers(0, 9, 4000), rng.integers(0, 40, 4000)]).astype("i4")
    g, h = rng.normal(size=4000) + (bins[0] > 20) + 0.3 * bins[1], rng.integers(1, 4, 4000).astype("f8")
    splits, met, plain = TS.Splits(bins), [], TS.Splits.sums
    monkeypatch.setattr(TS.Splits, "sums", lambda self, cells, place, *a: met.append(len(place)) or plain(self, cells, place, *a))
    column, cut, value, at = TS.grow(splits, None, g, h, 4, 1.0, np.ones(3, bool))
    assert met[0] == met[1] == 4000 and len(met) == 8 and max(met[2:]) < 2600  # lighter by ``h``, not by rows
    for node in range(15):  # each node's split is the best of its own rows
        rows, path = np.ones(4000, bool), []
        k = node
        while k:
            path.append(((k - 1) // 2, k % 2 == 0))
            k = (k - 1) // 2
        for up, right in path:
            rows &= (bins[column[up]] > cut[up]) == right
        gains = {}
        for j in range(3):
            for b in range(bins[j].max()):
                left = rows & (bins[j] <= b)
                right = rows & (bins[j] > b)
                if min(h[left].sum(), h[right].sum()) >= 1:
                    gains[j, b] = sum(g[z].sum() ** 2 / (h[z].sum() + TS.SHRINK) for z in (left, right))
        assert gains[column[node], cut[node]] == pytest.approx(max(gains.values()), rel=1e-9)
        assert value[2 * node + 1] == pytest.approx(g[rows & (bins[column[node]] <= cut[node])].sum() / (h[rows & (bins[column[node]] <= cut[node])].sum() + TS.SHRINK))
