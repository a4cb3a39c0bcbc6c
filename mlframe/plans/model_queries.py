"""Reduction, estimators, ensembles and searches (D, I, V, S5, S6)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mlframe.functions import arrays, metrics
from mlframe.operators import models, reduce, resample, split, tune
from mlframe.plans import recipes
from mlframe.plans.catalog import cells, query, r6
from mlframe.session import materialize, scratch_path, spread
from mlframe.sources import load_model, read_labelled_files, save_model

_LINE = ["l_quantity", "l_discount", "l_tax"]
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(t, *extra):
    """(train, test) of line prices, assembled."""
    df = t("lineitem", *_LINE_KEY, *_LINE, "l_extendedprice", *extra)
    train, test = split.train_test_split(models.assemble(df, _LINE), _LINE_KEY, 0.2, 1)
    return spread(train), test


def _vectors(t):
    """(train, test) of the labelled embeddings as feature vectors."""
    df = reduce.to_vector(t.spread("embeddings"), "embedding").select("vec_id", "label", "embedding", "features")
    return split.train_test_split(df, "vec_id", 0.2, 1)


def _toxic(t):
    """(train, test) of document labels with length features: a two-class task."""
    df = t.spread("documents", "doc_id", "n_chars", "text").join(t("labels"), "doc_id").select(
        "doc_id", "toxic", "quality", F.col("n_chars").cast("double").alias("n_chars"),
        F.length(F.regexp_replace("text", "[^.]", "")).cast("double").alias("stops"))
    df = models.assemble(df, ["n_chars", "stops"])
    return split.train_test_split(df, "doc_id", 0.25, 1)


def _regression_scores(model, test, label="l_extendedprice"):
    return recipes.regression_report(model.transform(test), label)


def _class_scores(model, test, label="label"):
    return metrics.score_table(model.transform(test), {
        "n": F.count(F.lit(1)), "accuracy": metrics.accuracy(label, "prediction")})


# --- recipes -----------------------------------------------------------------------------

@query()
def event_value_regression(t):
    """The flagship recipe."""
    _, scored = recipes.calendar_regression(t("events"), "event_id", "ts", "value", 0.2, 7)
    return recipes.regression_report(scored, "value")


@query()
def text_quality_classifier(t):
    """Whole texts to a thresholded prediction."""
    df = t.spread("documents", "doc_id", "lang", "text").join(t("labels"), "doc_id")
    return recipes.text_classification(df, "doc_id", ["lang", "text"], "quality", None, 0.2, 3)[1]


@query("""
SELECT c_mktsegment AS class_name, row_number() OVER (ORDER BY c_mktsegment) - 1 AS class_index, 1 AS files FROM (SELECT DISTINCT c_mktsegment FROM customer)
""")
def class_folder_manifest(t):
    """Files of a folder per class, listed with their class index (file bytes are not read)."""
    path, df = scratch_path(t.spark, "classes"), t("customer")
    for (segment,) in df.select("c_mktsegment").distinct().collect():
        df.filter(F.col("c_mktsegment") == segment).coalesce(1).write.parquet(f"{path}/{segment}")
    files = read_labelled_files(t.spark, path, "*.parquet")
    return files.filter("length > 0").groupBy("class_name", "class_index").agg(F.count(F.lit(1)).alias("files"))


# --- reduction ---------------------------------------------------------------------------

@query()
def principal_axes(t):
    """The 5 leading coordinates, fitted on the training part."""
    train, test = _vectors(t)
    return cells(reduce.pca(test, "embedding", 5, fit_on=train), "pca", "vec_id")


@query()
def variance_explained(t):
    """D2."""
    return reduce.explained_variance(t("embeddings"), "embedding")


@query()
def components_needed(t):
    """D3."""
    return reduce.components_for(reduce.explained_variance(t("embeddings"), "embedding"))


@query()
def score_per_components(t):
    """D4."""
    train, test = _vectors(t)
    return reduce.component_sweep(train, test, "embedding", "label", [2, 8, 32],
                                  models.fit_score("classification", "tree", 10, maxDepth=5))


@query()
def discriminant_axes(t):
    """D5."""
    train, test = _vectors(t)
    return cells(reduce.lda(test, "embedding", "label", 3, fit_on=train), "lda", "vec_id")


def _tree_models(train, label="l_extendedprice"):
    small = {"tree": {"maxDepth": 5}, "forest": {"numTrees": 10}, "gbt": {"maxIter": 5}}
    return {n: models.estimator("regression", n, label, **p).fit(train) for n, p in small.items()}


@query()
def tree_importances(t):
    """D6."""
    train, _ = _lines(t)
    return reduce.feature_importance(t.spark, _tree_models(train.persist()), _LINE)


@query()
def gain_shares(t):
    """D7."""
    train, _ = _lines(t)
    model = models.estimator("regression", "gbt", "l_extendedprice", maxIter=5).fit(train)
    table = reduce.feature_importance(t.spark, {"gbt": model}, _LINE).filter("importance > 0")
    names = t.spark.createDataFrame([(c,) for c in _LINE], "feature string")
    return reduce.normalized_gain(table.withColumnRenamed("importance", "gain"), names)


@query()
def importance_threshold_sweep(t):
    """Each importance as threshold, refit and score."""
    train, test = _lines(t)
    train, test = train.persist(), test.persist()
    gains = models.estimator("regression", "forest", "l_extendedprice", numTrees=5).fit(train).featureImportances.toArray()

    def fit_score(a, b, features):
        return models.fit_score("regression", "tree")(a, b, features, "l_extendedprice")

    return reduce.select_from_model_sweep(train, test, "features", _LINE, gains, fit_score)[0]


@query("""
WITH i AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_discount, l_extendedprice)) AS b, abs(corr(l_tax, l_extendedprice)) AS c,
                  abs(corr(CAST(l_linenumber AS DOUBLE), l_extendedprice)) AS d FROM lineitem),
l AS (SELECT 'l_quantity' AS f, a AS v FROM i UNION ALL SELECT 'l_discount', b FROM i UNION ALL SELECT 'l_tax', c FROM i UNION ALL SELECT 'l_linenumber', d FROM i),
k AS (SELECT f FROM l WHERE v > (SELECT quantile_cont(v, 0.25) FROM l))
SELECT u.f AS column_name, count(*) AS n, round(sum(u.x), 2) AS total FROM (
  SELECT 'l_quantity' AS f, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT 'l_tax', l_tax FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem) u JOIN k ON u.f = k.f GROUP BY u.f
""")
def weak_features_dropped(t):
    """Columns at or below the 25th percentile of the importances go."""
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    df = t("lineitem")
    found = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), "l_extendedprice")).alias(c) for c in cols])
    importances = found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in cols])))
    kept = reduce.drop_low_importance(df.select(*cols), importances, 0.25)
    sums = kept.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in kept.columns])
    return sums.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(c, 2).alias("total"))
                                               for c in kept.columns])))


# --- estimators --------------------------------------------------------------------------

@query()
def linear_regression(t):
    """I1."""
    train, test = _lines(t)
    return _regression_scores(models.estimator("regression", "linear", "l_extendedprice").fit(train), test)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def linear_fit(t):
    """I1 with one feature, whose coefficients have a closed form."""
    df = models.assemble(t("lineitem", "l_quantity", "l_extendedprice"), ["l_quantity"])
    model = models.estimator("regression", "linear", "l_extendedprice").fit(df)
    return t.spark.createDataFrame([(round(float(model.coefficients[0]), 4), round(float(model.intercept), 4))],
                                   "slope double, intercept double")


@query("""
WITH f AS (SELECT regr_slope(o_totalprice, month(o_orderdate)) AS b, regr_intercept(o_totalprice, month(o_orderdate)) AS a FROM orders)
SELECT o_orderkey, round(a + b * month(o_orderdate), 4) AS prediction FROM orders, f
""")
def scored_table(t):
    """Every row of a table scored in one pass by a fitted chain."""
    df = t("orders").select("o_orderkey", F.month("o_orderdate").alias("m"), "o_totalprice")
    model = models.chain(models.assembler(["m"]), models.estimator("regression", "linear", "o_totalprice")).fit(df)
    return models.batch_score(model, df.drop("o_totalprice"), ["o_orderkey"]).withColumn("prediction", F.round("prediction", 4))


@query()
def ridge_regression(t):
    """I2."""
    train, test = _lines(t)
    return _regression_scores(models.estimator("regression", "ridge", "l_extendedprice").fit(train), test)


@query()
def logistic_regression(t):
    """I3."""
    train, test = _vectors(t)
    return _class_scores(models.estimator("classification", "logistic", "label", maxIter=30).fit(train.persist()), test)


@query()
def linear_svm(t):
    """I4: two classes, and one-versus-rest for ten."""
    train, test = _toxic(t)
    two = models.estimator("classification", "svm", "quality", maxIter=20).fit(train)
    vtrain, vtest = _vectors(t)
    ten = models.estimator("classification", "svm", "label", classes=10, maxIter=10).fit(vtrain.persist())
    return _class_scores(two, test, "quality").withColumn("task", F.lit("two")).unionByName(
        _class_scores(ten, vtest).withColumn("task", F.lit("ten")))


@query()
def decision_trees(t):
    """Regression and classification."""
    train, test = _lines(t)
    vtrain, vtest = _vectors(t)
    reg = models.score(models.estimator("regression", "tree", "l_extendedprice").fit(train).transform(test), "l_extendedprice", "regression")
    cls = models.score(models.estimator("classification", "tree", "label").fit(vtrain).transform(vtest), "label", "classification")
    return t.spark.createDataFrame([("r2", reg), ("accuracy", cls)], "metric string, score double")


@query()
def random_forest(t):
    """I6."""
    train, test = _vectors(t)
    return _class_scores(models.estimator("classification", "forest", "label", numTrees=20, maxDepth=7).fit(train), test)


@query()
def gradient_boosting(t):
    """I7."""
    train, test = _lines(t)
    return _regression_scores(models.estimator("regression", "gbt", "l_extendedprice", maxIter=5).fit(train.persist()), test)


def _price_classes(t):
    """(train, test) of line items in ten classes of the price paid, seen through price, discount and tax."""
    cols = ["l_extendedprice", "l_discount", "l_tax"]
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = t("lineitem", *_LINE_KEY, *cols).withColumn("label", F.least(F.lit(9), F.floor(paid / 10_000)).cast("int"))
    train, test = split.train_test_split(models.assemble(df, cols), _LINE_KEY, 0.2, 1)
    return spread(train), test


@query()
def multiclass_boosting(t):
    """Softmax boosting over ten classes; the probabilities of a row add up to one."""
    train, test = _price_classes(t)
    done = models.estimator("classification", "gbt", "label", classes=10, maxIter=2, maxDepth=4, stepSize=0.6).fit(train).transform(test)
    total = F.aggregate(vector_to_array("prediction_prob"), F.lit(0.0), lambda a, b: a + b)
    return metrics.score_table(done, {"n": F.count(F.lit(1)), "accuracy": metrics.accuracy("label", "prediction"), "whole": F.max(F.abs(total - 1)) < 1e-9})


@query()
def boosting_stopped_early(t):
    """I8: the number of trees kept with a validation part."""
    train, test = _lines(t)
    fit, valid = split.train_test_split(train.persist(), _LINE_KEY, 0.2, 5)
    model = models.fit_early_stopped(fit, valid, "regression", "l_extendedprice", maxIter=15, stepSize=0.5)
    return _regression_scores(model, test).withColumn("trees", F.lit(model.getNumTrees))


@query()
def multilayer_perceptron(t):
    """I9."""
    train, test = _vectors(t)
    est = models.estimator("classification", "mlp", "label", layers=[64, 16, 10], maxIter=40)
    return _class_scores(est.fit(train.persist()), test)


@query()
def kmeans_as_classes(t):
    """Clusters read as classes by majority, and their cost."""
    train, test = _vectors(t)
    train.persist()
    model = models.fit_kmeans(train, 10, seed=1)
    hit = models.cluster_predict(model, test, "label", fit_on=train).agg(metrics.accuracy("label", "prediction").alias("accuracy")).first()[0]
    return models.cluster_cost(model, test).withColumn("accuracy", F.lit(hit))


@query()
def bagged_models(t):
    """Three trees on samples drawn with replacement, their mean; and the one-job form."""
    train, test = _lines(t)
    train.persist()
    rows = train.select(*_LINE_KEY, "features", "l_extendedprice")  # what moves with the draws
    bag = models.fit_bag(rows, _LINE_KEY, "regression", "tree", "l_extendedprice", 3, seed=2)
    voted = models.predict_all(bag, test).withColumn("voted", models.mean_vote(list(bag)))
    both = models.fit_tree_bag(train, "regression", "l_extendedprice", 10).transform(voted)
    return recipes.regression_reports(both, "l_extendedprice", {"samples": "voted", "one job": "prediction"})


# Scores of three members for four classes: the sums of a vector's cells by position modulo twelve.
_MEMBERS = """k AS (SELECT vec_id, [list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(1, len(embedding) + 1) IF i % 12 = (c + 1) % 12]) FOR c IN range(12)] AS s FROM embeddings)"""


def _members(t):
    sums = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("s", arrays.sums_by_position("x", 12))
    return sums.select("vec_id", *[F.slice("s", i, 4).alias(m) for m, i in (("a", 1), ("b", 5), ("c", 9))])


@query(f"""
WITH {_MEMBERS},
m AS (SELECT vec_id, list_position(s[1:4], list_max(s[1:4])) - 1 AS a, list_position(s[5:8], list_max(s[5:8])) - 1 AS b,
             list_position(s[9:12], list_max(s[9:12])) - 1 AS c FROM k),
v AS (SELECT vec_id, p, count(*) AS n FROM (SELECT vec_id, unnest([a, b, c]) AS p FROM m) GROUP BY ALL)
SELECT vec_id, CAST(p AS DOUBLE) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, p) AS r FROM v) WHERE r = 1
""")
def hard_voting(t):
    """Three members, the smallest class on ties."""
    df = _members(t).select("vec_id", *[arrays.argmax(m).alias(m) for m in ("a", "b", "c")])
    return df.select("vec_id", models.hard_vote(["a", "b", "c"]).alias("prediction"))


@query(f"""
WITH {_MEMBERS}, m AS (SELECT vec_id, [s[1] + s[5] + s[9], s[2] + s[6] + s[10], s[3] + s[7] + s[11], s[4] + s[8] + s[12]] AS s FROM k)
SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS DOUBLE) AS prediction FROM m
""")
def soft_voting(t):
    """The largest mean score."""
    return _members(t).select("vec_id", models.soft_vote(["a", "b", "c"]).alias("prediction"))


@query("SELECT p_partkey, round((p_size + p_retailprice + p_partkey) / 3, 6) AS prediction FROM part")
def mean_voting(t):
    """The mean of three members."""
    df = t("part", "p_partkey", "p_size", "p_retailprice").withColumn("prediction", models.mean_vote(["p_size", "p_retailprice", "p_partkey"]))
    return df.select("p_partkey", r6("prediction").alias("prediction"))


@query()
def voted_classifiers(t):
    """Fitted members, hard and soft."""
    train, test = _vectors(t)
    train.persist()
    members = {n: models.estimator("classification", n, "label", prediction=n, **p).fit(train)
               for n, p in (("logistic", {"maxIter": 20}), ("tree", {}), ("forest", {"numTrees": 10}))}
    done = models.predict_all(members, test, keep_probability=True)
    done = done.withColumns({"hard": models.hard_vote(list(members)), "soft": models.soft_vote([f"{m}_prob" for m in members])})
    return metrics.score_table(done, {"hard": metrics.accuracy("label", "hard"), "soft": metrics.accuracy("label", "soft")})


@query()
def voted_boosting(t):
    """Soft and hard vote of two boosted members and a linear one over ten classes."""
    train, test = _price_classes(t)
    train.persist()
    made = {"shallow": ("gbt", {"maxDepth": 3}), "deep": ("gbt", {"maxDepth": 5}), "linear": ("logistic", {})}  # all rounds of a learner
    members = {n: models.estimator("classification", kind, "label", prediction=n, classes=10, **p).fit(train) for n, (kind, p) in made.items()}
    train.unpersist()
    done = models.predict_all(members, test, keep_probability=True)
    done = done.withColumns({"hard": models.hard_vote(list(members)), "soft": models.soft_vote([f"{m}_prob" for m in members])})
    return metrics.score_table(done, {c: metrics.accuracy("label", c) for c in (*members, "hard", "soft")})


@query()
def stacked_models(t):
    """A ridge over out-of-fold predictions, inputs passed through."""
    train, test = _lines(t)
    folded = tune.with_folds(train.persist(), _LINE_KEY, 3, 4).select("features", "l_extendedprice", "fold").persist()
    bases = {"linear": lambda n: models.estimator("regression", "linear", "l_extendedprice", prediction=n),
             "tree": lambda n: models.estimator("regression", "tree", "l_extendedprice", prediction=n)}
    return _regression_scores(models.fit_stack(folded, "fold", "l_extendedprice", bases), test)


@query()
def class_weighted_fit(t):
    """Balanced weights against a rare class."""
    train, test = _toxic(t)
    done = models.fit_weighted(train, "toxic", maxIter=20).transform(test)
    return metrics.score_table(done, {"n": F.count(F.lit(1)), "f1": metrics.f1_binary("toxic", "prediction"),
                                      "accuracy": metrics.accuracy("toxic", "prediction")})


@query()
def two_stage_prediction(t):
    """I16: discount and tax are predicted first, then the price."""
    df = t("lineitem", *_LINE_KEY, "l_quantity", *[c for c in _LINE if c != "l_quantity"], "l_extendedprice")
    train, test = split.train_test_split(df, _LINE_KEY, 0.2, 1)
    model = models.fit_two_stage(train, ["l_quantity"], ["l_discount", "l_tax"], "l_extendedprice")
    return _regression_scores(model, test.drop("l_discount", "l_tax"))


@query()
def saved_model_scores(t):
    """A fitted chain is stored, loaded and applied to the unlabelled table."""
    train, test = _lines(t)
    path = scratch_path(t.spark, "model")
    save_model(models.estimator("regression", "linear", "l_extendedprice").fit(train), path)
    return models.batch_score(load_model(path), test.drop("l_extendedprice"), _LINE_KEY)


# --- searches ----------------------------------------------------------------------------

@query()
def scaled_estimator(t):
    """V1: scaling statistics and estimator as one chain."""
    from pyspark.ml.feature import MinMaxScaler
    train, test = _lines(t)
    steps = models.chain(MinMaxScaler(inputCol="features", outputCol="scaled"),
                         models.estimator("regression", "forest", "l_extendedprice", "scaled", numTrees=5))
    return _regression_scores(steps.fit(train), test)


# With one feature the fit has a closed form, so SQL can check the folds.
_FOLDS = """r AS (SELECT l_quantity AS x, l_extendedprice AS y, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('3:' || l_orderkey || ':' || l_linenumber
  || ':' || l_partkey || ':' || l_suppkey)) AS rn FROM lineitem),
f AS (SELECT *, CASE WHEN rn <= (n % {k}) * (n // {k} + 1) THEN (rn - 1) // (n // {k} + 1) ELSE n % {k} + (rn - 1 - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS fold FROM r),
m AS (SELECT g.fold, regr_slope(f.y, f.x) AS b, regr_intercept(f.y, f.x) AS a FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY g.fold)"""


def _one_feature_folds(t, k):
    df = models.assemble(t.spread("lineitem", *_LINE_KEY, "l_quantity", "l_extendedprice"), ["l_quantity"]).persist()
    return tune.with_folds(df, _LINE_KEY, k, 3).select("features", "l_extendedprice", "fold")


@query("WITH " + _FOLDS.format(k=5) + """
SELECT fold, round(1 - avg(pow(y - a - b * x, 2)) / var_pop(y), 6) AS score FROM f JOIN m USING (fold) GROUP BY fold
""")
def cross_validated_scores(t):
    """V2: one score per fold."""
    scores = tune.cross_val_scores(_one_feature_folds(t, 5), lambda: models.estimator("regression", "linear", "l_extendedprice"),
                                   "l_extendedprice", "regression")
    return scores.withColumn("score", r6("score"))


@query("WITH " + _FOLDS.format(k=3) + """
SELECT fold, count(*) AS n, round(sqrt(avg(pow(y - a - b * x, 2))), 4) AS rmse, round(avg(a + b * x), 4) AS mean_p FROM f JOIN m USING (fold) GROUP BY fold
""")
def held_out_predictions(t):
    """V3: every row predicted by the model that did not see it."""
    bases = {"p": lambda n: models.estimator("regression", "linear", "l_extendedprice", prediction=n)}
    done = models.out_of_fold(_one_feature_folds(t, 3).persist(), "fold", bases)
    return done.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.rmse("l_extendedprice", "p"), 4).alias("rmse"),
                                    F.round(F.avg("p"), 4).alias("mean_p"))


_GRIDS = [{"maxDepth": [2, 4]}, {"minInstancesPerNode": [5, 50], "maxBins": [16]}]


def _search_input(t, folds=3):
    train, test = _lines(t)
    return tune.with_folds(train.persist(), _LINE_KEY, folds, 3).select("features", "l_extendedprice", "fold"), test


@query()
def grid_search(t):
    """V4: a list of grids, cross-validated, the best refitted."""
    train, _ = _search_input(t)
    return tune.search(train, models.estimator("regression", "tree", "l_extendedprice"), tune.expand(_GRIDS), "l_extendedprice", "regression")[0]


@query()
def random_search(t):
    """V5: three sampled combinations."""
    train, _ = _search_input(t)
    return tune.search(train, models.estimator("regression", "tree", "l_extendedprice"),
                       tune.sampled({"maxDepth": [2, 3, 4, 5], "maxBins": [8, 16, 32]}, 3, 1), "l_extendedprice", "regression")[0]


@query("""
WITH RECURSIVE s AS (
  SELECT 0 AS round, 45 AS candidates, 30::BIGINT AS n_rows, (SELECT count(*) FROM orders) AS top
  UNION ALL SELECT round + 1, CAST(ceil(candidates / 3.0::DOUBLE) AS INTEGER), n_rows * 3, top FROM s WHERE n_rows * 3 <= top AND round < 3)
SELECT round, candidates, n_rows FROM s
""")
def halving_schedule(t):
    """V6, V7: candidates and rows per round on the orders table."""
    return tune.schedule_frame(t.spark, tune.halving_schedule(45, 30, t("orders").count(), 3))


def _halving(t, candidates):
    train, _ = _lines(t)
    train = train.persist()
    rows = max(60, train.count() // 27)
    est = models.estimator("regression", "tree", "l_extendedprice")
    return tune.halving_search(train, est, candidates, "l_extendedprice", "regression", _LINE_KEY, rows, 3, 2, 1)[0]


@query()
def halving_grid_search(t):
    """V6: the rows grow as the candidates fall."""
    return _halving(t, tune.expand(_GRIDS))


@query()
def halving_random_search(t):
    """V7."""
    return _halving(t, tune.sampled({"maxDepth": [2, 3, 4, 5], "maxBins": [8, 16, 32]}, 4, 2))


@query()
def chain_search(t):
    """V8: parameters of one stage of a chain, addressed by its place."""
    from pyspark.ml.feature import StandardScaler
    train, _ = _search_input(t, 2)
    steps = models.chain(StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
                         models.estimator("regression", "tree", "l_extendedprice", "scaled"))
    return tune.search(train, steps, tune.expand({"1__maxDepth": [2, 4], "0__withStd": [True]}), "l_extendedprice", "regression")[0]


@query()
def bounded_search(t):
    """V9: candidates drawn from ranges, whole numbers rounded, one range on a log scale."""
    train, _ = _search_input(t, 2)
    box = {"maxDepth": tune.Bounds(2, 5, whole=True), "minInstancesPerNode": tune.Bounds(1, 200, whole=True, log=True)}
    return tune.search(train, models.estimator("regression", "tree", "l_extendedprice"), tune.from_bounds(box, 3, 4),
                       "l_extendedprice", "regression")[0]


@query()
def all_estimators(t):
    """Every known classifier tried, failures reported."""
    train, test = _toxic(t)
    makers = tune.default_makers("classification", "quality", classes=2, width=2)
    makers["perceptron of wrong width"] = lambda: models.estimator("classification", "mlp", "quality", layers=[9, 2], maxIter=1)
    return tune.try_estimators(train.persist(), test.persist(), "quality", "classification", makers)


def _line_parts(t):
    train, test = split.train_test_split(t("lineitem", *_LINE_KEY, *_LINE, "l_extendedprice"), _LINE_KEY, 0.2, 1)
    return spread(train), test


@query()
def dataset_scaler_model_grid(t):
    """Result table over datasets, scalers and models; the best three of each dataset."""
    from mlframe.operators.publish import top_per_group
    orders = t("orders").select("o_orderkey", F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y"), "o_totalprice")
    data = {"lines": (*_line_parts(t), _LINE, "l_extendedprice", "regression"),
            "orders": (*split.train_test_split(orders, "o_orderkey", 0.2, 1), ["m", "y"], "o_totalprice", "regression")}
    makers = {n: lambda label, kind, n=n: models.estimator(kind, n, label) for n in ("linear", "tree")}
    table = tune.benchmark_grid(data, ["none", "minmax"], makers)
    return top_per_group(table, "dataset", [F.col("score").desc(), "scaler", "model"], 3)


@query()
def parameter_sweep(t):
    """Step size of a boosted model against a linear penalty, with times."""
    train, test = _lines(t)
    makers = {"gbt": lambda rate: models.estimator("regression", "gbt", "l_extendedprice", maxIter=3, stepSize=rate),
              "linear": lambda rate: models.estimator("regression", "linear", "l_extendedprice", regParam=rate)}
    return tune.sweep(train.persist(), test.persist(), "l_extendedprice", "regression", makers, {"rate": [0.1, 0.01]})


@query()
def scaler_comparison(t):
    """V13."""
    parts = [materialize(d.select(*_LINE, "l_extendedprice"), "parts") for d in _line_parts(t)]  # read by every scaler
    return tune.compare_scalers(*parts, _LINE, "l_extendedprice", "regression",
                                lambda label, kind: models.estimator(kind, "linear", label, regParam=0.1))


@query()
def winner_refitted(t):
    """Scores on a validation part; the smallest error is refitted on both parts."""
    train, test = _lines(t)
    fit, valid = split.train_test_split(train.persist(), _LINE_KEY, 0.25, 9)
    makers = {n: lambda n=n: models.estimator("regression", n, "l_extendedprice") for n in ("linear", "tree")}
    table, model, _ = tune.refit_winner(fit.persist(), valid.persist(), "l_extendedprice", makers)
    final = model.transform(test).agg(metrics.rmse("l_extendedprice", "prediction")).first()[0]
    return table.withColumn("test_rmse", F.when(F.col("winner"), F.lit(final)))


@query()
def scenario_comparison(t):
    """One classifier on the whole, a reduced and an oversampled training table."""
    train, test = _vectors(t)
    train = train.select("vec_id", "label", "embedding", "features").persist()
    last_label = train.agg(F.max("label")).first()[0]
    rare_rows = train.filter(F.col("label") == last_label).count() * 3 // 4
    rare = split.drop_tail(train, ["label", "vec_id"], rare_rows)
    over = resample.oversample(rare, "vec_id", "label", "auto", 1)
    points = resample.smote(rare, "vec_id", "embedding", "label", 3, "auto", 1)
    scenarios = {"whole": train, "reduced": rare, "oversampled": over, "interpolated": reduce.to_vector(points, "embedding")}
    scenarios = {n: d.select("features", "label") for n, d in scenarios.items()}
    return tune.compare_scenarios(scenarios, test, "label", "classification",
                                  lambda: models.estimator("classification", "tree", "label", maxDepth=6))


