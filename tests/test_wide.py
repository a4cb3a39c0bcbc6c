"""Logistic regression with its coefficients in a table, against MLlib's with them on the driver."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mlframe.operators import models, wide
from mlframe.plans import recipes

FAR = (1 << 31) - 1


def _rows(spark, seed=0, n=300, width=60, far=False, label=lambda x, noise: x[:, :5].sum(axis=1) - x[:, 5:10].sum(axis=1) + noise > 0):
    """Word counts where one feature is the same in every row and one in none; `far` puts the features at large numbers."""
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.4, (n, width)).astype(float)
    x[:, 20], x[:, 21] = 2.0, 0.0
    y = label(x, rng.normal(0, 1, n)).astype(int)
    at = FAR - 1 - 1000 * np.arange(width)[::-1] if far else np.arange(width)
    size = FAR if far else width
    made = [(i, int(y[i]), Vectors.sparse(size, [(int(at[j]), x[i, j]) for j in np.flatnonzero(x[i])])) for i in range(n)]
    return spark.createDataFrame(made, ["id", "y", "features"])


def _scores(model, df):
    rows = model.transform(df).select("id", "prediction", vector_to_array("prediction_prob").alias("p"), vector_to_array("prediction_raw").alias("m")).collect()
    return {r["id"]: (r["prediction"], *r["p"], *r["m"]) for r in rows}


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(wide, "CELLS", 700)
    monkeypatch.setattr(wide, "ENTRIES", 100)


@pytest.mark.parametrize("params", [{"maxIter": 12, "regParam": 0.01}, {"maxIter": 30, "regParam": 0.5, "tol": 1e-3}])
def test_same_scores_as_mllib(spark, small_parts, params):
    df = _rows(spark)
    train, test = df.filter("id < 240"), df.filter("id >= 240")
    plain = models.estimator("classification", "logistic", "y", **params).fit(train)
    kept = models.estimator("classification", "logistic", "y", width=models.WIDE + 1, **params).fit(train)
    assert isinstance(kept, wide.WideLogisticModel)
    a, b = _scores(plain, test), _scores(kept, test)
    assert a.keys() == b.keys() and np.allclose([a[i] for i in a], [b[i] for i in a], atol=1e-4)
    assert np.isclose(kept.intercept, plain.intercept, atol=1e-4)
    at = {int(i): c for r in kept.coefficients.collect() for i, c in zip(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["coef"]))}
    assert np.allclose([at.get(j, 0.0) for j in range(60)], plain.coefficients.toArray(), atol=1e-4)


def test_more_features_than_an_array_on_the_driver(spark, small_parts):
    near, far = (_rows(spark, far=f) for f in (False, True))
    a, b = (_scores(models.estimator("classification", "logistic", "y", width=w, maxIter=4, regParam=0.01).fit(df), df)
            for w, df in ((60, near), (FAR, far)))
    assert np.allclose([a[i] for i in a], [b[i] for i in a], atol=1e-4)


def test_dense_vectors_other_columns_and_unseen_features(spark, small_parts):
    df = models.assemble(spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
                                                 F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("s"), (F.col("id") % 7 > 3).cast("int").alias("y")), ["a", "b"])
    plain, kept = (models.estimator("classification", "logistic", "y", width=w, maxIter=10, regParam=0.1).fit(df) for w in (0, FAR))
    out = kept.transform(df)
    assert out.columns == ["id", "a", "b", "s", "y", "prediction_raw", "prediction_prob", "prediction"]
    assert sorted(map(tuple, out.select("id", "a", "b", "s", "y").collect())) == sorted(map(tuple, df.select("id", "a", "b", "s", "y").collect()))
    a, b = _scores(plain, df), _scores(kept, df)
    assert np.allclose([a[i] for i in a], [b[i] for i in a], atol=1e-4)
    new = spark.createDataFrame([(1, Vectors.sparse(9, [(8, 4.0)])), (2, Vectors.sparse(9, [])), (2, Vectors.sparse(9, []))], ["id", "features"])
    assert np.allclose([r["m"][1] for r in kept.transform(new).select(vector_to_array("prediction_raw").alias("m")).collect()], kept.intercept)


def test_labels_of_one_kind_and_of_others(spark, small_parts):
    df = _rows(spark, n=20)
    est = models.estimator("classification", "logistic", "y", width=FAR, maxIter=3)
    for value, sure in ((1, 1.0), (0, 0.0)):
        rows = est.fit(df.withColumn("y", F.lit(value))).transform(df).select("prediction", vector_to_array("prediction_prob")[1].alias("p")).collect()
        assert len(rows) == 20 and all(r["p"] == r["prediction"] == sure for r in rows)
    for wrong in (F.lit(2), F.when(F.col("id") > 3, F.col("y"))):
        with pytest.raises(ValueError):
            est.fit(df.withColumn("y", wrong))


def test_texts_of_many_words(spark, monkeypatch):
    """Past WIDE words the fit keeps nothing as long as the vocabulary on the driver, and reports the same."""
    rows = [(i, "good" if i % 2 else "bad", f"{'nice lovely' if i % 3 else 'awful'} thing {i % 7} word{i} other{i % 50}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, tag string, text string, y int")
    want = recipes.text_classification(df, "id", ["tag", "text"], "y", None, 0.2, 1)
    monkeypatch.setattr(models, "WIDE", 100)
    monkeypatch.setitem(models.CLASSIFIERS, "logistic", None)
    got = recipes.text_classification(df, "id", ["tag", "text"], "y", None, 0.2, 1)
    assert got[1].first() == want[1].first()
    a, b = ({r["id"]: r["score"] for r in part[0].collect()} for part in (got, want))
    assert a.keys() == b.keys() and np.allclose([a[i] for i in a], [b[i] for i in a], atol=1e-4)
