import numpy as np
import pytest
from pyspark.sql import functions as F

from mlframe.functions import metrics, rowfunc
from mlframe.operators import encode, models, reduce, resample, split, tune
from mlframe.operators.ordering import hash_cuts, md5_key
from mlframe.plans import QUERIES, recipes
from mlframe.sources import load_model, read_labelled_files, save_model


@pytest.fixture(scope="module")
def line(spark):
    """y = 3a - 2b + 5 with small noise."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 2))
    y = x @ [3.0, -2.0] + 5 + rng.normal(0, 0.01, 800)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(800)], "id long, a double, b double, y double")
    return models.assemble(df, ["a", "b"]).persist()


@pytest.fixture(scope="module")
def blobs(spark):
    """Three separable classes in 5 dimensions, one of them rare."""
    rng = np.random.default_rng(1)
    label = np.array([0] * 200 + [1] * 150 + [2] * 40)
    x = rng.normal(0, 4, (3, 5))[label] * 1.5 + rng.normal(size=(390, 5))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(390)], "id long, v array<double>, label int")
    return reduce.to_vector(df, "v").persist(), x, label


def test_linear_finds_the_coefficients(line):
    model = models.estimator("regression", "linear", "y").fit(line)
    assert np.allclose(model.coefficients.toArray(), [3, -2], atol=0.01) and abs(model.intercept - 5) < 0.01


def test_every_estimator_learns_separable_classes(blobs):
    df, _, _ = blobs
    train, test = split.stratified_split(df, "id", "label", 0.25, 1)
    makers = tune.default_makers("classification", "label", classes=3, width=5)
    makers["broken"] = lambda: models.estimator("classification", "mlp", "label", layers=[2, 2])
    table = tune.try_estimators(train, test, "label", "classification", makers).collect()
    scores = {r["model"]: r["score"] for r in table}
    assert scores.pop("broken") is None and table[-1]["error"]
    assert min(scores.values()) > 0.9, scores


def test_early_stopping_keeps_fewer_trees(line):
    train, valid = split.train_test_split(line, "id", 0.3, 1)
    noise = [d.withColumn("y", F.rand(1)) for d in (train, valid)]
    model = models.fit_early_stopped(*noise, "regression", "y", maxIter=20)
    assert model.getNumTrees < 20


def test_stack_and_bag(line):
    train, test = split.train_test_split(line, "id", 0.25, 1)
    folded = tune.with_folds(train, "id", 3, 1).persist()
    bases = {n: lambda out, n=n: models.estimator("regression", n, "y", prediction=out) for n in ("linear", "tree")}
    stack = models.fit_stack(folded, "fold", "y", bases, regParam=0.001)
    assert models.score(stack.transform(test), "y", "regression") > 0.99
    held = models.out_of_fold(folded, "fold", bases)
    assert held.count() == train.count() and held.filter("linear is null").count() == 0
    bag = models.fit_bag(train, "id", "regression", "tree", "y", 3)
    voted = models.predict_all(bag, test).withColumn("prediction", models.mean_vote(list(bag)))
    assert models.score(voted, "y", "regression") > 0.8


def test_two_stages_use_predicted_values(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, -1.0 * i, 5.0 * i) for i in range(50)], "id long, x double, m double, n double, y double")
    model = models.fit_two_stage(df, ["x"], ["m", "n"], "y")
    done = model.transform(df.select("id", "x", "y"))
    assert models.score(done, "y", "regression") > 0.999 and {"m_hat", "n_hat"} <= set(done.columns)


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, 2, [0.1, 0.9], [0.8, 0.2]), (3, 2, 0, [0.5, 0.5], [0.5, 0.5])],
                               "a int, b int, c int, p array<double>, q array<double>")
    got = df.select(models.hard_vote(["a", "b", "c"]).alias("h"), models.soft_vote(["p", "q"]).alias("s")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 0.0)]


def test_clusters_become_classes(blobs):
    df, x, _ = blobs
    model = models.fit_kmeans(df, 3, seed=3)
    assert models.score(models.cluster_predict(model, df, "label"), "label", "classification") > 0.9
    centres = np.array(model.clusterCenters())
    cost = -((x[:, None, :] - centres) ** 2).sum(-1).min(1).sum()
    assert np.isclose(models.cluster_cost(model, df).first()[0], cost)


def test_class_weights_lift_the_rare_class(blobs):
    df, _, _ = blobs
    rare = df.withColumn("y", (F.col("label") == 2).cast("int")).drop("label")
    noisy = rare.withColumn("features", reduce.array_to_vector(F.transform("v", lambda c: c + 8 * F.randn(1))))
    plain = models.estimator("classification", "logistic", "y").fit(noisy).transform(noisy)
    fair = models.fit_weighted(noisy, "y").transform(noisy)
    caught = [d.filter("y = 1 and prediction = 1").count() for d in (plain, fair)]
    assert caught[1] > caught[0]


def test_saved_model_gives_the_same_scores(line, tmp_path):
    model = models.estimator("regression", "tree", "y").fit(line)
    save_model(model, str(tmp_path / "m"))
    a, b = (models.batch_score(m, line, ["id"]).orderBy("id").collect() for m in (model, load_model(str(tmp_path / "m"))))
    assert a == b


def test_pca_equals_svd(blobs):
    df, x, _ = blobs
    got = np.array([r["pca"] for r in reduce.pca(df, "v", 3).orderBy("id").collect()])
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(c @ vt[:3].T), atol=1e-8)
    evr = reduce.explained_variance(df, "v")
    ratio = s ** 2 / (s ** 2).sum()
    assert np.allclose([r["ratio"] for r in evr.orderBy("component").collect()], ratio)
    need = {r["threshold"]: r["components"] for r in reduce.components_for(evr).collect()}
    assert need[1.0] == 5 and need[0.95] == int(np.argmax(ratio.cumsum() >= 0.95)) + 1


def test_lda_solves_the_eigenproblem(blobs):
    df, x, label = blobs
    mean, axes = reduce.fit_lda(df, "v", "label")
    assert axes.shape == (5, 2) and np.allclose(mean, x.mean(0))
    within = sum(np.cov(x[label == c].T, bias=True) * (label == c).sum() for c in range(3)) / (390 - 3)
    assert np.allclose(axes.T @ within @ axes, np.eye(2), atol=1e-8)
    z = np.array([r["lda"] for r in reduce.lda(df, "v", "label").orderBy("id").collect()])
    means = np.array([z[label == c].mean(0) for c in range(3)])
    assert ((z[:, None] - means) ** 2).sum(-1).argmin(1).tolist().count(2) >= 35
    with pytest.raises(ValueError):
        reduce.fit_lda(df, "v", "label", 3)


def test_importances(line, spark):
    fitted = {n: models.estimator("regression", n, "y").fit(line) for n in ("tree", "forest")}
    rows = reduce.feature_importance(spark, fitted, ["a", "b"]).collect()
    assert len(rows) == 4 and all(r["importance"] > 0 for r in rows)
    gains = spark.createDataFrame([("b", 1.0), ("a", 3.0)], "feature string, gain double")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    assert [tuple(r) for r in reduce.normalized_gain(gains, names).collect()] == [("a", 0.75), ("b", 0.25), ("c", 0.0)]


def test_threshold_sweep_drops_the_useless_feature(spark):
    frame, kept, dropped = reduce.sweep_thresholds({"a": 0.7, "b": 0.3, "z": 0.0}, lambda cols: 0.9 - 0.1 * ("z" in cols) - 0.5 * ("b" not in cols), spark)
    assert kept == ["a", "b"] and dropped == ["z"] and frame.count() == 3


def test_searches_find_the_better_depth(line):
    grid = tune.expand([{"maxDepth": [1, 5]}, {"maxDepth": [2], "maxBins": [4, 8]}])
    assert len(grid) == 4
    folded = tune.with_folds(line, "id", 3, 1)
    table, model, best = tune.search(folded, models.estimator("regression", "tree", "y"), grid, "y", "regression")
    assert best == {"maxDepth": 5} and model.depth == 5 and table.first()["rank"] == 1
    table, model, best = tune.halving_search(line, models.estimator("regression", "tree", "y"), grid, "y", "regression", "id", 90)
    assert best == {"maxDepth": 5}
    assert [(r["round"], r["n_rows"], r["count"]) for r in table.groupBy("round", "n_rows").count().orderBy("round").collect()] == [
        (0, 90, 4), (1, 270, 2)]


def test_candidates():
    assert tune.sampled({"a": [1, 2, 3], "b": [4, 5]}, 4, 1) == tune.sampled({"a": [1, 2, 3], "b": [4, 5]}, 4, 1)
    assert len({tuple(c.items()) for c in tune.sampled({"a": [1, 2, 3], "b": [4, 5]}, 10)}) == 6
    box = {"depth": tune.Bounds(2, 5, whole=True), "rate": tune.Bounds(0.001, 1.0, log=True)}
    drawn = tune.from_bounds(box, 50, 2)
    assert all(2 <= c["depth"] <= 5 and isinstance(c["depth"], int) and 0.001 <= c["rate"] <= 1 for c in drawn)
    assert sum(c["rate"] < 0.0316 for c in drawn) > 10


def test_winner_is_refitted(line):
    train, valid = split.train_test_split(line, "id", 0.3, 1)
    makers = {n: lambda n=n: models.estimator("regression", n, "y") for n in ("linear", "tree")}
    table, model, winner = tune.refit_winner(train, valid, "y", makers)
    assert winner == "linear" and np.allclose(model.coefficients.toArray(), [3, -2], atol=0.01)
    assert table.filter("winner").first()["model"] == "linear"


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(size=200), rng.normal(size=200)
    c, d = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    s = np.round(rng.random(200), 1)
    df = spark.createDataFrame([(float(a), float(b), int(e), int(f), float(g)) for a, b, e, f, g in zip(y, p, c, d, s)],
                               "y double, p double, c int, d int, s double")
    row = metrics.score_table(df, {"mse": metrics.mse("y", "p"), "r2": metrics.r2("y", "p"), "mae": metrics.mae("y", "p"),
                                   "nrmse": metrics.nrmse("y", "p"), "huber": metrics.huber("y", "p")}).first()
    e = np.abs(y - p)
    assert np.allclose([row["mse"], row["r2"], row["mae"]], [(e ** 2).mean(), 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum(), e.mean()])
    assert np.isclose(row["nrmse"], np.sqrt((e ** 2).mean()) / (y.max() - y.min()))
    assert np.isclose(row["huber"], np.where(e <= 1, e ** 2 / 2, e - 0.5).mean())
    f1 = []
    for k in range(4):
        tp, fp, fn = ((c == k) & (d == k)).sum(), ((c != k) & (d == k)).sum(), ((c == k) & (d != k)).sum()
        f1.append(2 * tp / (2 * tp + fp + fn))
    assert np.isclose(metrics.f1_macro(df, "c", "d").first()[0], np.mean(f1))
    aucs = {r["class"]: r["auc"] for r in metrics.roc_auc_per_class(df, "c", {k: "s" for k in range(3)}).collect()}
    for k in range(3):
        pos, neg = s[c == k], s[c != k]
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert np.isclose(aucs[k], wins / (len(pos) * len(neg)))


def test_user_functions(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 1.0, "b")], "y double, p double, g string")
    got = rowfunc.user_metrics(df, "y", "p", {"e": metrics.mae}, ["g"]).orderBy("g").collect()
    assert [(r["g"], r["e"]) for r in got] == [("a", 1.0), ("b", 2.0)]


def test_labelled_folders(spark, tmp_path):
    for cls, n in (("zebra", 2), ("ant", 1)):
        (tmp_path / cls).mkdir()
        for i in range(n):
            (tmp_path / cls / f"{i}.png").write_bytes(b"x" * (i + 1))
    rows = read_labelled_files(spark, str(tmp_path), "*.png").collect()
    assert sorted((r["class_name"], r["class_index"], r["length"]) for r in rows) == [("ant", 0, 1), ("zebra", 1, 1), ("zebra", 1, 2)]


def test_recipes_learn(spark):
    rows = [(i, "good" if i % 2 else "bad", f"{'nice lovely' if i % 2 else 'awful'} thing {i % 7}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, tag string, text string, y int")
    report = recipes.text_classification(df, "id", ["tag", "text"], "y", 100, 0.2, 1)[1].first()
    assert report["f1"] == 1.0 and report["n"] == 40
    ts = spark.range(500).select("id", F.timestamp_seconds(F.col("id") * 3600 * 5).alias("ts"))
    ts = ts.withColumn("v", F.hour("ts") * 2.0 + F.weekday("ts"))
    _, scored = recipes.calendar_regression(ts, "id", "ts", "v")
    assert recipes.regression_report(scored, "v").first()["r2"] > 0.99


def test_decoding(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8])], "id int, p array<double>")
    assert encode.name_scores(df, "p", ["no", "yes"], ["id"]).first().asDict() == {"id": 1, "no": 0.2, "yes": 0.8}


def test_bags_are_exact_draws_of_all_rows(spark):
    df = spark.range(300).select("id", F.col("id").cast("double").alias("y"))
    rows = resample.bag_counts(df, "id", 3, 1).collect()
    for b in range(3):
        assert sum(r["drawn"][b] for r in rows) == 300
        assert 0.5 < sum(r["drawn"][b] > 0 for r in rows) / 300 < 0.75  # about 1 - 1/e of the rows
    assert len({tuple(r["drawn"]) for r in rows}) > 3 and resample.bag_counts(df.limit(0), "id", 2).count() == 0


@pytest.mark.parametrize("name", ["linear", "tree"])
def test_counts_as_weights_fit_like_copies(spark, name):
    df = models.assemble(spark.range(400).select("id", (F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                                 (F.col("id") % 37 * 2 + F.col("id") % 5).cast("double").alias("y")), ["a", "b"])
    bag = models.fit_bag(df, "id", "regression", name, "y", 2, seed=4)
    counts = resample.bag_counts(df, "id", 2, 4)
    for i in range(2):
        times = F.get("drawn", F.lit(i)).cast("int")
        copies = counts.filter(times > 0).withColumn("c", F.explode(F.sequence(F.lit(1), times)))
        plain = models.estimator("regression", name, "y", prediction=f"bag_{i}", seed=4 + i).fit(copies)
        a, b = (sorted((r["id"], round(r[f"bag_{i}"], 6)) for r in m.transform(df).collect()) for m in (bag[f"bag_{i}"], plain))
        assert np.allclose([v for _, v in a], [v for _, v in b], atol=1e-5)


def test_bags_of_a_learner_without_weights(spark):
    df = models.assemble(spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y")), ["a"])
    bag = models.fit_bag(df, "id", "classification", "mlp", "y", 2, layers=[1, 2, 2], maxIter=5)
    assert models.predict_all(bag, df).count() == 60


def test_reports_of_several_columns_in_one_pass(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("y"), (F.col("id") * 1.5).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    for rows in (df, df.limit(0)):
        got = recipes.regression_reports(rows, "y", {"first": "a", "second": "b"})
        assert got.columns == ["n", "rmse", "r2", "mae", "form"]
        want = [(*recipes.regression_report(rows.withColumn("prediction", F.col(c)), "y").first(), form) for c, form in (("a", "first"), ("b", "second"))]
        assert [tuple(r) for r in got.collect()] == want


def test_bagged_models_read_the_test_rows_once(spark):
    report = QUERIES["bagged_models"](spark, "/root/testdata/sf0.001")
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert [r["form"] for r in report.collect()] == ["samples", "one job"]
    spark.catalog.clearCache()


def test_cuts_among_many_rows_of_a_prefix_take_two_passes(spark, monkeypatch):
    df = spark.range(12_000).select((F.col("id") % 2).alias("k"))
    digests = sorted(r[0] for r in df.select(md5_key("k", 3)).collect())
    passes, collect = [], type(df).collect

    def counted(self):
        passes.append(1)
        return collect(self)
    monkeypatch.setattr(type(df), "collect", counted)
    sizes, cuts = hash_cuts(df, "k", 3, lambda sizes: {0: [1, 6_000, 6_001, 12_000]})
    assert sizes == {0: 12_000} and cuts == {0: {r: digests[r - 1] for r in (1, 6_000, 6_001, 12_000)}}
    assert len(passes) == 2
    assert hash_cuts(df.limit(0), "k", 3, lambda sizes: {}) == ({}, {})
