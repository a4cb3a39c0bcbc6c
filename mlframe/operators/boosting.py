"""Gradient boosting for any number of classes: a softmax over one sum of regression trees per class.

Each round fits, side by side, one regression tree per class to what is left of that class's probability, on a stored
table of features, label and current scores. Leaves then get the Newton step of the multinomial loss, from one
aggregate over (class, leaf), and the new scores are written for the next round. Scoring adds leaf values looked up in
literal arrays, so it is one pass with one column of probabilities, as soft voting needs it.

A tree tells values apart only by the bins of its features. Where the bins have far fewer combinations than there are
rows, rows of equal bins and label become one row with the sum of their weights: residuals, splits and leaf values are
the same, and the rounds no longer grow with the table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasSeed, HasStepSize, HasWeightCol
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.session import in_threads, materialize

CLASSES = 1000  # classes a model can have: each costs a tree a round
MOST = 4.0  # largest step of a leaf
DRAWN = 10_000  # rows the cut points of the bins come from, the square of the bins at least, as in MLlib's trees
MERGE = 4  # rows a combination of bins and label has to stand for, on average


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasMaxIter, HasStepSize, HasSeed, HasWeightCol):
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows of a leaf at least", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(maxIter=20, stepSize=0.3, maxDepth=5, minInstancesPerNode=1, maxBins=32, seed=0)


def _once(value: Column, use) -> Column:
    """`use(value)` with the value computed once; inside a lambda it would be computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _softmax(scores: Column) -> Column:
    raised = _once(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(s - top)))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, b: a + b)
    return _once(raised, lambda r: _once(total(r), lambda t: F.transform(r, lambda e: e / t)))


def _steps(values: list[float], weights: list[float], most: int, total: float) -> list[float]:
    """Cut points of one feature by the rule of MLlib's trees: between all values if they are few, else at even weight."""
    weight_of: dict[float, float] = {}
    for v, w in zip(values, weights):
        weight_of[v] = weight_of.get(v, 0.0) + w
    found = sorted(weight_of.items())
    if len(found) - 1 <= most:
        return [(a + b) / 2 for (a, _), (b, _) in zip(found, found[1:])]
    stride = total / (most + 1)
    cuts, upto, target = [], found[0][1], stride
    for (a, _), (b, w) in zip(found, found[1:]):
        before, upto = upto, upto + w
        if abs(before - target) < abs(upto - target):
            cuts.append((a + b) / 2)
            target += stride
    return cuts


def _cut_points(rows: DataFrame, n: int, total: float, bins: int, seed: int) -> list[list[float]]:
    """Cut points of every feature of `rows` (x, w), at most bins - 1 each."""
    share = min(1.0, max(bins * bins, DRAWN) / n)
    drawn = (rows if share == 1.0 else rows.sample(share, seed)).select(vector_to_array("x").alias("x"), "w").collect()
    weights = [r["w"] for r in drawn]
    return [_steps(list(column), weights, min(bins, n) - 1, share * total) for column in zip(*(r["x"] for r in drawn))]


def _binned(features: str, cuts: list[list[float]]) -> Column:
    """The bin numbers of a feature vector: how many cut points lie below each value."""
    points = F.array(*[F.array(*map(F.lit, c)) if c else F.array().cast("array<double>") for c in cuts])
    return F.transform(vector_to_array(features), lambda v, i: F.size(F.filter(F.get(points, i), lambda c: c < v)).cast("double"))


class SoftmaxBoosting(Estimator, _Shared):
    """Boosted trees for labels 0, 1, ..., k - 1 (null labels take no part)."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction",
                 maxIter=20, stepSize=0.3, maxDepth=5, minInstancesPerNode=1, maxBins=32, seed=0, weightCol=None):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> SoftmaxBoostingModel:
        label, weight = F.col(self.getLabelCol()), F.col(self.getWeightCol()) if self.isDefined("weightCol") else F.lit(1.0)
        rows = df.select(F.col(self.getFeaturesCol()).alias("x"), label.cast("int").alias("y"), weight.cast("double").alias("w")).filter("y is not null")
        rows = materialize(rows, "boosting")
        each = rows.groupBy("y").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows")).limit(CLASSES + 1).collect()
        sizes, n = {r["y"]: r["n"] for r in each}, sum(r["rows"] for r in each)
        many = max(sizes, default=0) + 1
        if len(sizes) > CLASSES or many > CLASSES or min(sizes, default=0) < 0:
            raise ValueError(f"labels must be whole numbers from 0 to {CLASSES - 1}")
        total = sum(sizes.values())
        start = [math.log(max(sizes.get(c, 0.0), 0.5) / max(total, 1.0)) for c in range(many)]
        cuts = None
        if n and self.getOrDefault("minInstancesPerNode") == 1:  # merged rows no longer tell how many they were
            found = _cut_points(rows, n, total, self.getOrDefault("maxBins"), self.getSeed())
            if found and math.prod(len(c) + 1 for c in found) * len(sizes) * MERGE <= n:
                cuts = found
                merged = rows.groupBy(_binned("x", cuts).alias("bins"), "y").agg(F.sum("w").alias("w"))
                rows = materialize(merged.select(array_to_vector("bins").alias("x"), "y", "w"), "boosting")
        state = rows.withColumn("scores", F.array(*map(F.lit, start)))
        rounds: list[list] = []
        for i in range(self.getMaxIter()):
            p = _softmax(F.col("scores"))
            target = state.withColumn("p", p).withColumns({f"r{c}": F.when(F.col("y") == c, 1.0).otherwise(0.0) - F.get("p", F.lit(c)) for c in range(many)})
            made = _trees(self, target, many, i)
            placed = reduce(lambda d, m: m.transform(d), [m for _, m in made], target)
            # one aggregate for all trees: gradient and curvature of every leaf
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"leaf{c}").cast("int").alias("leaf"), F.col(f"r{c}").alias("r"), "w") for c in range(many)])).alias("e")
            size = F.abs(F.col("e.r"))
            steps = placed.select(each).groupBy("e.c", "e.leaf").agg(F.sum(F.col("e.w") * F.col("e.r")).alias("g"), F.sum(F.col("e.w") * size * (1 - size)).alias("h")).collect()
            values = [[0.0] * m.numLeaves() for _, m in made]
            for s in steps:
                newton = (many - 1) / many * s["g"] / s["h"] if s["h"] > 1e-12 else 0.0
                values[s["c"]][s["leaf"]] = self.getStepSize() * max(-MOST, min(MOST, newton))
            rounds.append([(m, v) for (_, m), v in zip(made, values)])
            if i + 1 < self.getMaxIter():
                state = materialize(_added(placed, "scores", values).select("x", "y", "w", "scores"), "boosting")
        return self._copyValues(SoftmaxBoostingModel(start, rounds, cuts))


def _trees(est: SoftmaxBoosting, df: DataFrame, many: int, i: int) -> list:
    """A tree per class, fitted side by side on the same stored rows."""
    df = df.persist()

    def one(c: int):
        tree = DecisionTreeRegressor(featuresCol="x", labelCol=f"r{c}", predictionCol=f"out{c}", leafCol=f"leaf{c}", weightCol="w", maxDepth=est.getOrDefault("maxDepth"),
                                     minInstancesPerNode=est.getOrDefault("minInstancesPerNode"), maxBins=est.getOrDefault("maxBins"), seed=est.getSeed() + i)
        return c, tree.fit(df)

    out = in_threads([lambda c=c: one(c) for c in range(many)], 8)
    df.unpersist()
    return [(c, _Leaves(m)) for c, m in out]


class _Leaves:
    """A fitted tree that adds the number of a row's leaf, and nothing else: a step of the plan for each tree."""

    def __init__(self, model):
        self.model = model.copy({model.predictionCol: ""})

    def numLeaves(self) -> int:
        return (self.model.numNodes + 1) // 2

    def transform(self, df: DataFrame, features: str = "x") -> DataFrame:
        return (self.model if features == "x" else self.model.copy({self.model.featuresCol: features})).transform(df)


def _added(df: DataFrame, scores: str, values: list[list[float]]) -> DataFrame:
    """Scores with the values of the rows' leaves (columns leaf0, leaf1, ...) added."""
    steps = [F.get(F.array(*map(F.lit, v)), F.col(f"leaf{c}").cast("int")) for c, v in enumerate(values)]
    return df.withColumn(scores, F.zip_with(F.col(scores), F.array(*steps), lambda a, b: a + b))


class SoftmaxBoostingModel(Model, _Shared):
    """`start` scores per class and, per round and class, a tree with the values of its leaves.

    With `cuts` (cut points of each feature) the trees take bin numbers in place of the features.
    """

    def __init__(self, start: list[float], rounds: list[list], cuts: list[list[float]] | None = None):
        super().__init__()
        self._defaults()
        self.start, self.rounds, self.cuts = start, rounds, cuts

    @property
    def numClasses(self) -> int:
        return len(self.start)

    def _scored(self, df: DataFrame, features: str) -> DataFrame:
        kept = [F.col(f"`{c}`") for c in df.columns]
        out = df.withColumn("_scores", F.array(*map(F.lit, self.start)))
        for trees in self.rounds:
            for tree, _ in trees:
                out = tree.transform(out, features)
            out = _added(out, "_scores", [v for _, v in trees]).select(*kept, "_scores")
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = [F.col(f"`{c}`") for c in df.columns]
        if self.cuts is None:
            out = self._scored(df, self.getFeaturesCol())
        else:  # a combination of bins goes through the trees once, however many rows have it
            binned = df.withColumn("_bins", _binned(self.getFeaturesCol(), self.cuts))
            each = self._scored(binned.select("_bins").distinct().withColumn("_x", array_to_vector("_bins")), "_x")
            out = binned.join(each.select("_bins", "_scores"), "_bins", "left")
        p = _softmax(F.col("_scores"))
        best = (F.array_position(F.col("_scores"), F.array_max("_scores")) - 1).cast("double")
        return out.select(*kept, array_to_vector("_scores").alias(self.getRawPredictionCol()), array_to_vector(p).alias(self.getProbabilityCol()),
                          best.alias(self.getPredictionCol()))
