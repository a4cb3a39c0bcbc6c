"""Dimension reduction and feature selection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.operators.quantiles import exact_quantiles


def to_vector(df: DataFrame, arr: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(arr).cast("array<double>")))


def fit_pca(df: DataFrame, arr: str, k: int) -> PipelineModel:
    """Centring and projection on the k leading axes."""
    stages = [StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
              PCA(k=k, inputCol="_centred", outputCol="_projected")]
    return Pipeline(stages=stages).fit(to_vector(df, arr, "_raw"))


def pca(df: DataFrame, arr: str, k: int, fit_on: DataFrame | None = None, out: str = "pca",
        model: PipelineModel | None = None) -> DataFrame:
    """Centred projection, fitted on `fit_on` (default: `df`)."""
    model = model or fit_pca(df if fit_on is None else fit_on, arr, k)
    done = model.transform(to_vector(df, arr, "_raw"))
    return done.withColumn(out, vector_to_array("_projected")).drop("_raw", "_centred", "_projected")


def explained_variance(df: DataFrame, arr: str, k: int | None = None) -> DataFrame:
    """(component, ratio, cumulative) for all components, or the first k."""
    k = k or df.agg(F.max(F.size(arr))).first()[0]
    ratios = fit_pca(df, arr, k).stages[-1].explainedVariance.toArray()
    frame = df.sparkSession.createDataFrame(
        [(i + 1, float(r)) for i, r in enumerate(ratios)], "component int, ratio double")
    running = Window.partitionBy(F.lit(0)).orderBy("component")  # one row per component
    return frame.withColumn("cumulative", F.sum("ratio").over(running))


def components_for(evr: DataFrame, thresholds: Sequence[float] = (0.95, 0.99, 0.999, 1.0)) -> DataFrame:
    """The smallest number of components whose cumulative ratio reaches each threshold."""
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    reached = F.col("cumulative") >= F.col("threshold") - F.lit(1e-9)
    return evr.withColumn("threshold", wanted).groupBy("threshold").agg(
        F.min(F.when(reached, F.col("component"))).alias("components"))


def component_sweep(train: DataFrame, test: DataFrame, arr: str, label: str, ks: Sequence[int],
                    fit_score: Callable[[DataFrame, DataFrame, str, str], float]) -> DataFrame:
    """Score per number of components. Axes are nested, so one fit serves every k."""
    model = fit_pca(train, arr, max(ks))
    full = [pca(d, arr, max(ks), model=model).select(label, "pca") for d in (train, test)]
    rows = []
    for k in ks:
        a, b = (to_vector(d.withColumn("pca", F.slice("pca", 1, k)), "pca") for d in full)
        rows.append((k, float(fit_score(a, b, "features", label))))
    return train.sparkSession.createDataFrame(rows, "components int, score double")


def _scatter_by_class(df: DataFrame, arr: str, label: str, shift: np.ndarray):
    """{class: (rows, sum of x - shift, sum of its outer products)}: partial sums per task, then a grouped sum."""
    d = len(shift)

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            for c, part in pdf.groupby(label):
                x = np.stack(part[arr].to_numpy()).astype(float) - shift
                n, s, ss = acc.get(c, (0, np.zeros(d), np.zeros((d, d))))
                acc[c] = (n + len(x), s + x.sum(axis=0), ss + x.T @ x)
        yield pd.DataFrame({label: list(acc), "sums": [np.concatenate([[n], s, ss.ravel()]) for n, s, ss in acc.values()]})

    schema = T.StructType([df.schema[label], T.StructField("sums", T.ArrayType(T.DoubleType()))])
    parts = df.select(label, arr).mapInPandas(partial, schema)
    sums = parts.groupBy(label).agg(Summarizer.sum(array_to_vector("sums")).alias("s")).collect()
    out = {}
    for r in sums:
        v = r["s"].toArray()
        out[r[label]] = (v[0], v[1:d + 1], v[d + 1:].reshape(d, d))
    return out


def fit_lda(df: DataFrame, arr: str, label: str, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the directions that best separate the classes, at most classes - 1.

    Spark sums the scatter matrices; the driver only solves a d x d eigenproblem.
    """
    mean = df.select(Summarizer.mean(array_to_vector(F.col(arr).cast("array<double>")))).first()[0].toArray()
    groups = _scatter_by_class(df, arr, label, mean)
    limit = min(len(groups) - 1, len(mean))
    if k is not None and k > limit:
        raise ValueError(f"{k} axes asked for, at most {limit} exist")
    within = sum(ss - np.outer(s, s) / n for n, s, ss in groups.values())
    between = sum(np.outer(s, s) / n for n, s, _ in groups.values())
    n = sum(g[0] for g in groups.values())
    values, vectors = np.linalg.eigh(within / (n - len(groups)))
    solid = values > values.max() * 1e-12
    white = vectors[:, solid] / np.sqrt(values[solid])
    strength, axes = np.linalg.eigh(white.T @ between @ white)
    order = np.argsort(strength)[::-1][:k or limit]
    axes = white @ axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0)
    return mean, axes


def lda(df: DataFrame, arr: str, label: str, k: int | None = None, fit_on: DataFrame | None = None,
        out: str = "lda", fitted: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    mean, axes = fitted or fit_lda(df if fit_on is None else fit_on, arr, label, k)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()).astype(float) - mean) @ axes))

    return df.withColumn(out, project(F.col(arr)))


def feature_importance(spark: SparkSession, models: Mapping[str, object], names: Sequence[str]) -> DataFrame:
    """(model, feature, importance) of fitted tree models."""
    rows = [(m, n, float(v)) for m, model in models.items()
            for n, v in zip(names, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def normalized_gain(gains: DataFrame, names: DataFrame) -> DataFrame:
    """Shares of the total gain for every feature name, 0 where it has none, largest first."""
    total = gains.agg(F.sum("gain")).first()[0] or 1.0
    share = F.coalesce(F.col("gain"), F.lit(0.0)) / F.lit(total)
    joined = names.select("feature").join(gains.select("feature", "gain"), "feature", "left")
    return joined.select("feature", share.alias("share")).orderBy(F.desc("share"), "feature")


def sweep_thresholds(importances: Mapping[str, float],
                     fit_score: Callable[[Sequence[str]], float], spark: SparkSession) -> tuple[DataFrame, list[str], list[str]]:
    """Refit with the features at or above each importance.

    Returns (result frame, best feature list, dropped names); the best score wins, then
    the smaller feature set.
    """
    rows = []
    for cut in sorted(set(importances.values())):
        kept = [n for n, v in importances.items() if v >= cut]
        rows.append((float(cut), len(kept), float(fit_score(kept)), kept))
    best = max(rows, key=lambda r: (r[2], -r[1]))
    frame = spark.createDataFrame([r[:3] for r in rows], "threshold double, features int, score double")
    return frame, best[3], [n for n in importances if n not in best[3]]


def select_from_model_sweep(train: DataFrame, test: DataFrame, features: str, names: Sequence[str], importances: Sequence[float],
                            fit_score: Callable[[DataFrame, DataFrame, str], float]) -> tuple[DataFrame, list[str], list[str]]:
    """The threshold sweep on an assembled vector column."""
    from pyspark.ml.feature import VectorSlicer

    place = {n: i for i, n in enumerate(names)}

    def score(kept):
        slicer = VectorSlicer(inputCol=features, outputCol="_kept", indices=[place[n] for n in kept])
        return fit_score(slicer.transform(train), slicer.transform(test), "_kept")

    return sweep_thresholds(dict(zip(names, map(float, importances), strict=True)), score, train.sparkSession)


def drop_low_importance(df: DataFrame, importances: DataFrame, q: float = 0.25) -> DataFrame:
    """Drop the columns whose importance is at or below the q-quantile of all importances."""
    cut = exact_quantiles(importances, ["importance"], [q])["importance"][0]
    low = [r["feature"] for r in importances.filter(F.col("importance") <= cut).select("feature").collect()]
    return df.drop(*[c for c in low if c in df.columns])


__all__ = ["component_sweep", "components_for", "drop_low_importance", "explained_variance", "feature_importance",
           "fit_lda", "fit_pca", "lda", "normalized_gain", "pca", "select_from_model_sweep", "sweep_thresholds", "to_vector"]
