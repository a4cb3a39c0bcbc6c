"""Softmax boosting: score floors, probabilities, and the Newton steps of a round against a plain computation."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mlframe.operators import models
from mlframe.operators.boosting import SoftmaxBoosting
from mlframe.plans import QUERIES


@pytest.fixture(scope="module")
def rings(spark):
    """Four classes by quadrant and radius: no linear rule tells them apart."""
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (1500, 3))
    y = 2 * (x[:, 0] * x[:, 1] > 0) + ((x[:, :2] ** 2).sum(axis=1) > 0.6)
    df = spark.createDataFrame([(i, Vectors.dense(x[i]), int(y[i])) for i in range(1500)], ["id", "features", "label"])
    return df, x, y


def test_four_classes(rings):
    df, _, y = rings
    est = models.estimator("classification", "gbt", "label", classes=4, maxIter=6, maxDepth=4, stepSize=0.5)
    assert isinstance(est, SoftmaxBoosting)
    out = est.fit(df.filter("id >= 400")).transform(df.filter("id < 400"))
    rows = out.select("id", "prediction", vector_to_array("prediction_prob").alias("p")).collect()
    assert np.mean([r["prediction"] == y[r["id"]] for r in rows]) > 0.9
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and np.argmax(r["p"]) == r["prediction"] for r in rows)


def test_first_round_is_a_newton_step(rings):
    df, x, y = rings
    model = SoftmaxBoosting(maxIter=1, maxDepth=2, stepSize=1.0).fit(df)
    p = np.bincount(y) / len(y)
    assert np.allclose(model.start, np.log(p))
    trees = [t for t, _ in model.rounds[0]]
    placed = df
    for c, tree in enumerate(trees):
        placed = tree.transform(placed, "features")
    leaf = np.array([[r[f"leaf{c}"] for c in range(4)] for r in placed.orderBy("id").collect()]).astype(int)
    for c in range(4):
        r = (y == c) - p[c]
        for n, value in enumerate(model.rounds[0][c][1]):
            mine = r[leaf[:, c] == n]
            want = 0.75 * mine.sum() / (np.abs(mine) * (1 - np.abs(mine))).sum()
            assert np.isclose(value, np.clip(want, -4, 4))
    out = model.transform(df).select("id", vector_to_array("rawPrediction").alias("s")).orderBy("id").collect()
    want = np.log(p) + np.array([[model.rounds[0][c][1][leaf[i, c]] for c in range(4)] for i in range(len(y))])
    assert np.allclose([r["s"] for r in out], want)


def test_loss_falls_and_weights_count(rings):
    df, _, y = rings
    losses = []
    for n in (1, 3):
        out = SoftmaxBoosting(maxIter=n, maxDepth=3).fit(df).transform(df).select("id", vector_to_array("probability").alias("p")).collect()
        losses.append(-np.mean([np.log(r["p"][y[r["id"]]]) for r in out]))
    assert losses[1] < losses[0] < np.log(4)
    heavy = df.withColumn("w", F.when(F.col("label") == 0, 50.0).otherwise(1.0))
    share = lambda m: m.transform(df).filter("prediction = 0").count()
    assert share(SoftmaxBoosting(maxIter=1, maxDepth=1, weightCol="w").fit(heavy)) > share(SoftmaxBoosting(maxIter=1, maxDepth=1).fit(df))


def test_rows_of_equal_bins_are_merged(spark):
    """With few combinations of bins the trees see one row for each, and the scores are those of all the rows."""
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 5, 3000), rng.integers(0, 4, 3000)], axis=1).astype(float)
    y = ((x.sum(axis=1) + rng.integers(0, 2, 3000)) % 3).astype(int)
    df = spark.createDataFrame([(i, Vectors.dense(x[i]), int(y[i])) for i in range(3000)], ["id", "features", "label"])
    est = SoftmaxBoosting(maxIter=2, maxDepth=3)
    merged, plain = est.fit(df), est.copy({est.minInstancesPerNode: 2}).fit(df)  # every leaf holds more than two rows here
    assert merged.cuts == [[0.5, 1.5, 2.5, 3.5], [0.5, 1.5, 2.5]] and plain.cuts is None
    got, want = ([r["p"] for r in m.transform(df).orderBy("id").select(vector_to_array("probability").alias("p")).collect()] for m in (merged, plain))
    assert np.allclose(got, want)


def test_members_of_a_soft_vote(rings):
    df, _, y = rings
    members = {n: models.estimator("classification", "gbt", "label", prediction=n, classes=4, maxIter=2, maxDepth=d).fit(df) for n, d in (("a", 2), ("b", 4))}
    done = models.predict_all(members, df, keep_probability=True).withColumn("soft", models.soft_vote(["a_prob", "b_prob"]))
    for r in done.limit(50).collect():
        assert r["soft"] == np.argmax(np.array(r["a_prob"]) + np.array(r["b_prob"]))
    assert done.columns == ["id", "features", "label", "a", "a_prob", "b", "b_prob", "soft"]


def test_labels_must_be_class_numbers(rings, spark):
    df, _, _ = rings
    with pytest.raises(ValueError):
        SoftmaxBoosting(maxIter=1).fit(df.withColumn("label", F.col("label") - 1))
    with pytest.raises(ValueError):
        SoftmaxBoosting(maxIter=1).fit(df.withColumn("label", F.lit(100_000)))


@pytest.mark.parametrize("name,least", [("multiclass_boosting", {"accuracy": 0.85}), ("voted_boosting", {"shallow": 0.75, "deep": 0.8, "hard": 0.8, "soft": 0.8})])
def test_score_floors_of_the_queries(spark, name, least):
    row = QUERIES[name](spark, "/root/testdata/sf0.001").first()
    assert all(row[c] >= v for c, v in least.items())
    if name == "multiclass_boosting":
        assert row["whole"]


def test_members_of_the_voted_query_take_all_their_rounds(spark, monkeypatch):
    taken, fit = [], SoftmaxBoosting._fit

    def short(self, df):
        taken.append((self.getMaxIter(), self.getStepSize(), self.getOrDefault("maxDepth")))
        return fit(self.copy({self.maxIter: 1}), df)
    monkeypatch.setattr(SoftmaxBoosting, "_fit", short)
    members, estimator = {}, models.estimator

    def noted(kind, name, label, **params):
        members[params["prediction"]] = estimator(kind, name, label, **params)
        return members[params["prediction"]]
    monkeypatch.setattr(models, "estimator", noted)
    QUERIES["voted_boosting"](spark, "/root/testdata/sf0.001")
    assert taken == [(20, 0.3, 3), (20, 0.3, 5)] and members["linear"].getMaxIter() == 100


def test_rows_of_equal_bins_are_scored_once(spark):
    rows = [(i, Vectors.dense(float(i % 6), float(i % 4)), (i % 6 + i % 4) % 3) for i in range(1200)]
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    model = SoftmaxBoosting(maxIter=1, maxDepth=2).fit(df)
    seen, scored = [], model._scored
    model._scored = lambda part, features: seen.append(part.count()) or scored(part, features)
    out = model.transform(df.union(df.filter("id < 3")))
    assert out.columns == ["id", "features", "label", "rawPrediction", "probability", "prediction"]
    got = sorted((r["id"], r["features"]) for r in out.collect())
    assert got == sorted((i, x) for i, x, _ in rows + rows[:3]) and seen == [12]
