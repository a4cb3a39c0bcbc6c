"""Estimators by name, ensembles and scoring, all through Spark MLlib.

A model is fitted on an assembled `features` vector. Predictions of several models are
added to the same rows as columns, so voting and stacking need no joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.functions import metrics
from mlframe.operators.boosting import SoftmaxBoosting
from mlframe.operators.profile import class_weights
from mlframe.operators.resample import bag_counts
from mlframe.operators.wide import WideLogistic
from mlframe.session import materialize

REGRESSORS: dict[str, Callable] = {
    "linear": mlr.LinearRegression,
    "ridge": lambda **kw: mlr.LinearRegression(**{"elasticNetParam": 0.0, "regParam": 1.0, **kw}),
    "tree": mlr.DecisionTreeRegressor,
    "forest": mlr.RandomForestRegressor,
    "gbt": mlr.GBTRegressor,
}
CLASSIFIERS: dict[str, Callable] = {
    "logistic": mlc.LogisticRegression,
    "svm": mlc.LinearSVC,
    "tree": mlc.DecisionTreeClassifier,
    "forest": mlc.RandomForestClassifier,
    "gbt": mlc.GBTClassifier,
    "mlp": mlc.MultilayerPerceptronClassifier,
}
TWO_CLASSES_ONLY = ("svm",)
SEEDED = ("tree", "forest", "gbt", "mlp")
WIDE = 1 << 18  # features up to which the driver holds the coefficients of a logistic fit and their history, some 60 MB


def assembler(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return assembler(cols, out).transform(df)


def estimator(kind: str, name: str, label: str, features: str = "features", prediction: str = "prediction",
              classes: int = 2, seed: int = 0, weight: str | None = None, width: int = 0, **params):
    """A named MLlib estimator; beyond two classes boosting takes its softmax form, other two-class learners one-versus-rest.

    A logistic fit of two classes that is told to expect more than WIDE features (`width`) keeps its coefficients in a table.
    """
    table = REGRESSORS if kind == "regression" else CLASSIFIERS
    if kind == "classification" and name == "logistic" and width > WIDE and classes == 2:
        table = {"logistic": WideLogistic}
    if kind == "classification" and name == "gbt" and classes > 2:
        table = {"gbt": SoftmaxBoosting}
    common = {"labelCol": label, "featuresCol": features, "predictionCol": prediction}
    args = {**common, **params}
    if name in SEEDED:
        args.setdefault("seed", seed)
    if weight:
        args["weightCol"] = weight
    if kind == "classification" and name != "svm":
        args["probabilityCol"] = f"{prediction}_prob"
        args["rawPredictionCol"] = f"{prediction}_raw"
    if kind == "classification" and classes > 2 and name in TWO_CLASSES_ONLY:
        inner = {k: v for k, v in args.items() if k not in ("labelCol", "predictionCol", "weightCol")}
        return mlc.OneVsRest(classifier=table[name](**inner), labelCol=label, featuresCol=features,
                             predictionCol=prediction, parallelism=4, **({"weightCol": weight} if weight else {}))
    return table[name](**args)


def chain(*stages) -> Pipeline:
    """Named steps fitted one after the other."""
    return Pipeline(stages=list(stages))


def score(df: DataFrame, label: str, kind: str, prediction: str = "prediction") -> float:
    """R² or accuracy of a predicted table."""
    metric = metrics.r2 if kind == "regression" else metrics.accuracy
    value = df.agg(metric(label, prediction)).first()[0]
    return float("nan") if value is None else float(value)


def fit_score(kind: str, name: str, classes: int = 2, **params) -> Callable:
    """(train, test, features, label) -> test score of a fresh fit."""
    def run(train, test, features, label):
        model = estimator(kind, name, label, features, classes=classes, **params).fit(train)
        return score(model.transform(test), label, kind)
    return run


def fit_weighted(df: DataFrame, label: str, name: str = "logistic", features: str = "features", **params):
    """A classifier trained with balanced class weights."""
    weights = class_weights(df, label).select(label, "weight")
    return estimator("classification", name, label, features, weight="weight", **params).fit(
        df.join(F.broadcast(weights), label))  # one row per class


def fit_early_stopped(train: DataFrame, valid: DataFrame, kind: str, label: str, features: str = "features",
                      tol: float = 0.01, **params):
    """Boosting that stops once the validation error no longer falls."""
    both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    est = estimator(kind, "gbt", label, features, validationTol=tol, **params)
    return est.setValidationIndicatorCol("_valid").fit(both)


def fit_kmeans(df: DataFrame, k: int, features: str = "features", seed: int = 0, **params):
    """k-means with the parallel form of the k-means++ seeding."""
    return KMeans(k=k, featuresCol=features, predictionCol="cluster", initMode="k-means||", seed=seed, **params).fit(df)


def clusters_to_classes(df: DataFrame, label: str, cluster: str = "cluster") -> DataFrame:
    """(cluster, class): the most frequent label of each cluster, the smallest on ties."""
    votes = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(cluster).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("class"))


def cluster_predict(model, df: DataFrame, label: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Clusters read as classes through the majority label of the fitting table."""
    table = clusters_to_classes(model.transform(df if fit_on is None else fit_on), label)
    return model.transform(df).join(F.broadcast(table), "cluster", "left").withColumnRenamed("class", "prediction")


def cluster_cost(model, df: DataFrame, features: str = "features") -> DataFrame:
    """Negative sum of squared distances to the assigned centres."""
    spark = df.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                                    "cluster int, centre array<double>")
    done = model.transform(df).withColumn("_x", vector_to_array(features)).join(F.broadcast(centres), "cluster")
    gap = F.aggregate(F.zip_with("_x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return done.agg((-F.sum(gap)).alias("cost"))


# --- ensembles -------------------------------------------------------------------------

def predict_all(models: Mapping[str, object], df: DataFrame, keep_probability: bool = False) -> DataFrame:
    """One prediction column per member, named after it (and `<name>_prob` arrays if asked)."""
    for name, model in models.items():
        before = df.columns
        df = model.transform(df)
        out = model.getPredictionCol() if hasattr(model, "getPredictionCol") else "prediction"
        cols = [F.col(c) for c in before] + [F.col(out).alias(name)]
        if keep_probability:
            cols.append(vector_to_array(f"{out}_prob").alias(f"{name}_prob"))
        df = df.select(*cols)
    return df


def hard_vote(members: Sequence[str]) -> Column:
    """The most frequent member prediction, the smallest on ties."""
    votes = F.array(*[F.col(m).cast("double") for m in members])
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)), -v))
    best = F.array_max(counted)
    return -best["col2"] + F.lit(0.0)


def soft_vote(members: Sequence[str]) -> Column:
    """The class with the largest mean probability over member probability arrays."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(m) for m in members])
    return (F.array_position(total, F.array_max(total)) - 1).cast("double")


def mean_vote(members: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(m) for m in members]) / float(len(members))


def fit_bag(df: DataFrame, key, kind: str, name: str, label: str, n: int = 10, bootstrap: bool = True,
            features: str = "features", seed: int = 0, **params) -> dict[str, object]:
    """n models of one kind on samples drawn with replacement (or all on the whole table).

    All bags share one stored copy of the rows with their counts, which the fits take as weights.
    Bagged trees have a faster form in one job: the forest with all features per split.
    """
    stored = materialize(bag_counts(df, key, n, seed, "_drawn") if bootstrap else df, "bags")
    models = {}
    for i in range(n):
        est = estimator(kind, name, label, features, prediction=f"bag_{i}", seed=seed + i, **params)
        sample = stored
        if bootstrap:
            times = F.get("_drawn", F.lit(i))
            sample = stored.filter(times > 0)
            if est.hasParam("weightCol"):
                sample, est = sample.withColumn("_times", times.cast("double")), est.copy({est.weightCol: "_times"})
            else:  # a learner without weights sees the copies
                sample = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
        models[f"bag_{i}"] = est.fit(sample)
    return models


def fit_tree_bag(df: DataFrame, kind: str, label: str, n: int = 10, bootstrap: bool = True, features: str = "features",
                 seed: int = 0, **params):
    """Bagging of trees as one distributed job."""
    return estimator(kind, "forest", label, features, seed=seed, numTrees=n, featureSubsetStrategy="all",
                     bootstrap=bootstrap, **params).fit(df)


def out_of_fold(df: DataFrame, fold: str, bases: Mapping[str, Callable[[str], object]]) -> DataFrame:
    """Each row predicted by every base fitted without the row's fold; one column per base."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    parts = []
    for f in folds:
        rest = df.filter(F.col(fold) != f)
        fitted = {n: make(n).fit(rest) for n, make in bases.items()}
        parts.append(predict_all(fitted, df.filter(F.col(fold) == f)))
    return reduce(lambda a, b: a.unionByName(b), parts)


class Stack:
    """Base models, a ridge on their out-of-fold predictions, the inputs passed through."""

    def __init__(self, bases: Mapping[str, object], head, passthrough: bool, features: str):
        self.bases, self.head, self.passthrough, self.features = bases, head, passthrough, features

    def transform(self, df: DataFrame) -> DataFrame:
        done = predict_all(self.bases, df)
        return self.head.transform(_stacked(done, list(self.bases), self.features, self.passthrough))


def _stacked(df: DataFrame, names: Sequence[str], features: str, passthrough: bool) -> DataFrame:
    return assemble(df, [*names, features] if passthrough else names, "_stacked")


def fit_stack(df: DataFrame, fold: str, label: str, bases: Mapping[str, Callable[[str], object]], features: str = "features",
              passthrough: bool = True, **head_params) -> Stack:
    """`bases` maps a name to a function giving an estimator whose prediction column has that name."""
    held_out = out_of_fold(df, fold, bases)
    head = estimator("regression", "ridge", label, "_stacked", **head_params).fit(
        _stacked(held_out, list(bases), features, passthrough))
    return Stack({n: make(n).fit(df) for n, make in bases.items()}, head, passthrough, features)


class TwoStage:
    """Intermediate targets are predicted first and join the inputs of the final model."""

    def __init__(self, first: Sequence[PipelineModel], final: PipelineModel):
        self.first, self.final = first, final

    def transform(self, df: DataFrame) -> DataFrame:
        for model in [*self.first, self.final]:
            df = model.transform(df)
            df = df.drop(*[c for c in df.columns if c.startswith("_in_")])
        return df


def fit_two_stage(df: DataFrame, cols: Sequence[str], intermediate: Sequence[str], target: str, name: str = "linear",
                  **params) -> TwoStage:
    first = [chain(assembler(cols, f"_in_{m}"), estimator("regression", name, m, f"_in_{m}", f"{m}_hat", **params)).fit(df)
             for m in intermediate]
    # trained on the true intermediate values, applied to the predicted ones
    seen = df.withColumns({f"{m}_hat": F.col(m).cast("double") for m in intermediate})
    inputs = [*cols, *[f"{m}_hat" for m in intermediate]]
    final = chain(assembler(inputs, "_in_final"), estimator("regression", name, target, "_in_final", **params)).fit(seen)
    return TwoStage(first, final)


def batch_score(model, df: DataFrame, keep: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Keys and predictions of an unlabelled table."""
    return model.transform(df).select(*keep, prediction)
