"""Cross-validation, parameter search, halving and comparison tables.

Data-parallel work runs inside each fit; independent fits share a few driver threads.
Every search returns its result table as a DataFrame.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import statistics
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.operators import models, scale
from mlframe.operators.split import kfold, sample_k, stratified_kfold
from mlframe.session import in_threads


def with_folds(df: DataFrame, key: str, k: int, seed: int = 0, label: str | None = None) -> DataFrame:
    """Folds in an int column, stratified if a label is named."""
    tagged = stratified_kfold(df, key, label, k, seed) if label else kfold(df, key, k, seed)
    return tagged.withColumn("fold", F.col("fold").cast("int"))


def cross_val_scores(df: DataFrame, make: Callable[[], object], label: str, kind: str, fold: str = "fold",
                     threads: int = 4) -> DataFrame:
    """(fold, score) of one estimator."""
    df = df.persist()
    folds = [int(r[0]) for r in df.select(fold).distinct().orderBy(fold).collect()]

    def one(f):
        model = make().fit(df.filter(F.col(fold) != f))
        return float(models.score(model.transform(df.filter(F.col(fold) == f)), label, kind))

    scores = in_threads([lambda f=f: one(f) for f in folds], threads)
    df.unpersist()
    return df.sparkSession.createDataFrame(list(zip(folds, scores)), "fold int, score double")


# --- candidates ------------------------------------------------------------------------

def expand(grids: Mapping | Sequence[Mapping]) -> list[dict]:
    """All combinations of a grid, or of a list of grids one after the other."""
    grids = [grids] if isinstance(grids, Mapping) else list(grids)
    return [dict(zip(g, combo)) for g in grids for combo in itertools.product(*g.values())]


def _uniform(seed: int, *parts) -> float:
    text = ":".join(map(str, (seed, *parts)))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2 ** 32


def sampled(grids, n: int, seed: int = 0) -> list[dict]:
    """n different combinations, all if there are fewer."""
    every = expand(grids)
    order = sorted(range(len(every)), key=lambda i: _uniform(seed, i))
    return [every[i] for i in order[:n]]


@dataclass(frozen=True)
class Bounds:
    """A range for one parameter; whole numbers are rounded, `log` draws the exponent evenly."""

    lo: float
    hi: float
    whole: bool = False
    log: bool = False

    def at(self, u: float):
        if self.log:
            value = math.exp(math.log(self.lo) + u * (math.log(self.hi) - math.log(self.lo)))
        else:
            value = self.lo + u * (self.hi - self.lo)
        value = min(self.hi, max(self.lo, value))
        return int(round(value)) if self.whole else value


def from_bounds(bounds: Mapping[str, Bounds], n: int, seed: int = 0) -> list[dict]:
    """n candidates drawn from a box."""
    return [{p: b.at(_uniform(seed, i, p)) for p, b in bounds.items()} for i in range(n)]


def param_map(stage, params: Mapping) -> dict:
    """MLlib parameter map; on a chain, `place__name` addresses a parameter of one stage."""
    out = {}
    for name, value in params.items():
        owner = stage
        if isinstance(stage, Pipeline):
            place, name = name.split("__", 1)
            owner = stage.getStages()[int(place)]
        out[owner.getParam(name)] = value
    return out


# --- searches --------------------------------------------------------------------------

def cross_validate(df: DataFrame, est, candidates: Sequence[Mapping], label: str, kind: str, fold: str = "fold",
                   threads: int = 4) -> list[list[float]]:
    """Fold scores of every candidate; all fits read one stored copy of the fold-tagged table."""
    df = df.persist()
    try:
        return _fold_scores(df, est, candidates, label, kind, fold, threads)
    finally:
        df.unpersist()


def _fold_scores(df: DataFrame, est, candidates: Sequence[Mapping], label: str, kind: str, fold: str, threads: int) -> list[list[float]]:
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]

    def one(params, f):
        model = est.fit(df.filter(F.col(fold) != f), param_map(est, params))
        return models.score(model.transform(df.filter(F.col(fold) == f)), label, kind)

    flat = in_threads([lambda c=c, f=f: one(c, f) for c in candidates for f in folds], threads)
    return [flat[i:i + len(folds)] for i in range(0, len(flat), len(folds))]


def _rating(score: float) -> float:
    """A score for ranking: one that is not a number comes last."""
    return -math.inf if math.isnan(score) else float(score)


def search(df: DataFrame, est, candidates: Sequence[Mapping], label: str, kind: str, fold: str = "fold",
           threads: int = 4, refit: bool = True):
    """Cross-validate every candidate, refit the best. Returns (result frame, best model, best params)."""
    df = df.persist()  # the last fit reads the stored copy as well
    try:
        scores = _fold_scores(df, est, candidates, label, kind, fold, threads)
        means = [statistics.fmean(s) for s in scores]
        stds = [statistics.pstdev(s) for s in scores]
        frame = result_frame(df.sparkSession, candidates, means, stds)
        best = dict(candidates[max(range(len(candidates)), key=lambda i: _rating(means[i]))])
        return frame, est.fit(df, param_map(est, best)) if refit else None, best
    finally:
        df.unpersist()


def result_frame(spark: SparkSession, candidates: Sequence[Mapping], means: Sequence[float], stds: Sequence[float]) -> DataFrame:
    """(params, mean_score, std_score, rank): rank 1 is the best, equal scores share one."""
    rows = [(", ".join(f"{k}={v}" for k, v in c.items()), float(m), float(s), 1 + sum(_rating(o) > _rating(m) for o in means))
            for c, m, s in zip(candidates, means, stds)]
    return spark.createDataFrame(rows, "params string, mean_score double, std_score double, rank int").orderBy("rank", "params")


@dataclass(frozen=True)
class Round:
    number: int
    candidates: int
    rows: int


def halving_schedule(candidates: int, min_rows: int, max_rows: int, factor: int = 3) -> list[Round]:
    """Each round keeps 1/factor of the candidates and multiplies the rows, within the table."""
    possible, rows = 1, min_rows
    while rows * factor <= max_rows:
        rows, possible = rows * factor, possible + 1
    needed, left = 1, candidates
    while left // factor >= 1:
        left, needed = left // factor, needed + 1
    rounds, left = [], candidates
    for i in range(min(possible, needed)):
        rounds.append(Round(i, left, min_rows * factor ** i))
        left = math.ceil(left / factor)
    return rounds


def schedule_frame(spark: SparkSession, rounds: Sequence[Round]) -> DataFrame:
    return spark.createDataFrame([(r.number, r.candidates, r.rows) for r in rounds], "round int, candidates int, n_rows long")


def halving_search(df: DataFrame, est, candidates: Sequence[Mapping], label: str, kind: str, key: str, min_rows: int,
                   factor: int = 3, folds: int = 3, seed: int = 0, stratify: bool = False, threads: int = 4):
    """Successive halving. Returns (result frame with the round, best model on all rows, best params)."""
    left, frames = list(candidates), []
    for r in halving_schedule(len(left), min_rows, df.count(), factor):
        part = with_folds(sample_k(df, key, r.rows, seed), key, folds, seed, label if stratify else None)
        frame, _, _ = search(part, est, left, label, kind, threads=threads, refit=False)
        frames.append(frame.withColumns({"round": F.lit(r.number), "n_rows": F.lit(r.rows)}))
        ranked = {row["params"]: row["mean_score"] for row in frame.collect()}
        left.sort(key=lambda c: -_rating(ranked[", ".join(f"{k}={v}" for k, v in c.items())]))
        left = left[:math.ceil(len(left) / factor)]
    best = dict(left[0])
    return reduce(DataFrame.unionByName, frames), est.fit(df, param_map(est, best)), best


# --- comparisons -----------------------------------------------------------------------

def try_estimators(train: DataFrame, test: DataFrame, label: str, kind: str, makers: Mapping[str, Callable[[], object]],
                   threads: int = 4) -> DataFrame:
    """(model, score, error): every estimator tried, failing ones reported, best first."""
    def one(name):
        try:
            return name, models.score(makers[name]().fit(train).transform(test), label, kind), None
        except Exception as e:  # noqa: BLE001 - a failing estimator is a result here
            return name, None, type(e).__name__
    rows = in_threads([lambda n=n: one(n) for n in makers], threads)
    frame = train.sparkSession.createDataFrame(rows, "model string, score double, error string")
    return frame.orderBy(F.col("score").desc_nulls_last(), "model")


def default_makers(kind: str, label: str, features: str = "features", classes: int = 2, width: int | None = None) -> dict:
    """Every known estimator with modest settings."""
    sizes = {"forest": {"numTrees": 10}, "gbt": {"maxIter": 5}, "svm": {"maxIter": 20},
             "mlp": {"layers": [width or 1, 16, classes], "maxIter": 30}}
    table = models.REGRESSORS if kind == "regression" else models.CLASSIFIERS
    return {n: lambda n=n: models.estimator(kind, n, label, features, classes=classes, **sizes.get(n, {})) for n in table}


def benchmark_grid(datasets: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str], str, str]], scalers: Sequence[str],
                   makers: Mapping[str, Callable[[str, str], object]]) -> DataFrame:
    """(dataset, scaler, model, score) over all combinations.

    A dataset is (train, test, columns, label, kind); a maker takes (label, kind).
    """
    rows, spark = [], None
    for dataset, (train, test, cols, label, kind) in datasets.items():
        spark = train.sparkSession
        for scaler in scalers:
            fitted = scale.FITTERS[scaler](train, cols) if scaler != "none" else {}
            a, b = (models.assemble(scale.apply_scale(d, fitted) if fitted else d, cols).select("features", label).persist()
                    for d in (train, test))
            for name, make in makers.items():
                rows.append((dataset, scaler, name, models.score(make(label, kind).fit(a).transform(b), label, kind)))
            a.unpersist()
            b.unpersist()
    return spark.createDataFrame(rows, "dataset string, scaler string, model string, score double")


def compare_scalers(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, kind: str,
                    make: Callable[[str, str], object]) -> DataFrame:
    """(scaler, score) of one estimator on one dataset."""
    table = benchmark_grid({"data": (train, test, cols, label, kind)}, ["none", *scale.FITTERS], {"model": make})
    return table.select("scaler", "score")


def sweep(train: DataFrame, test: DataFrame, label: str, kind: str,
          makers: Mapping[str, Callable[..., object]], values: Mapping[str, Sequence]) -> DataFrame:
    """(model, params, score, seconds) for every model and parameter combination."""
    rows = []
    for name, make in makers.items():
        for params in expand(values):
            start = time.time()
            value = models.score(make(**params).fit(train).transform(test), label, kind)
            rows.append((name, ", ".join(f"{k}={v}" for k, v in params.items()), value, time.time() - start))
    return train.sparkSession.createDataFrame(rows, "model string, params string, score double, seconds double")


def refit_winner(train: DataFrame, valid: DataFrame, label: str, makers: Mapping[str, Callable[[], object]]):
    """(model, rmse) table on the validation part, and the smallest one refitted on both parts."""
    from mlframe.functions.metrics import rmse

    rows = [(n, float(m().fit(train).transform(valid).agg(rmse(label, "prediction")).first()[0])) for n, m in makers.items()]
    frame = train.sparkSession.createDataFrame(rows, "model string, rmse double")
    winner = frame.agg(F.min_by("model", F.struct("rmse", "model"))).first()[0]
    return frame.withColumn("winner", F.col("model") == winner), makers[winner]().fit(train.unionByName(valid)), winner


def compare_scenarios(scenarios: Mapping[str, DataFrame], test: DataFrame, label: str, kind: str,
                      make: Callable[[], object]) -> DataFrame:
    """(scenario, n_rows, score): the same estimator fitted on several training tables."""
    rows = [(n, d.count(), models.score(make().fit(d).transform(test), label, kind)) for n, d in scenarios.items()]
    return test.sparkSession.createDataFrame(rows, "scenario string, n_rows long, score double")
