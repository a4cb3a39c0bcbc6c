"""Evaluation numbers over a prediction table.

Column-level metrics are aggregate expressions, usable in any `agg`. Metrics that need
classes or ranks are small jobs returning a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.operators.ordering import prefix_sum

EPS = 1e-15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _error(y, p) -> Column:
    return _c(y).cast("double") - _c(p)


def mse(y, p) -> Column:
    return F.avg(_error(y, p) * _error(y, p))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mae(y, p) -> Column:
    return F.avg(F.abs(_error(y, p)))


def huber(y, p, delta: float = 1.0) -> Column:
    e = F.abs(_error(y, p))
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * e - 0.5 * delta * delta))


def r2(y, p) -> Column:
    """1 - SSE/SST in one pass; null where the target does not vary."""
    return 1.0 - mse(y, p) / F.nullif(F.var_pop(_c(y).cast("double")), F.lit(0.0))


def r2_multi(ys: Sequence, ps: Sequence) -> Column:
    """Mean R² over several targets."""
    parts = [r2(y, p) for y, p in zip(ys, ps, strict=True)]
    return sum(parts[1:], parts[0]) / float(len(parts))


def nrmse(y, p) -> Column:
    """RMSE over the range of the target."""
    v = _c(y).cast("double")
    return rmse(y, p) / F.nullif(F.max(v) - F.min(v), F.lit(0.0))


def pearson_clipped(y, p) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.corr(_c(y).cast("double"), _c(p).cast("double"))))


def composite_score(y, p) -> Column:
    """Half the (capped) range-normalised error, turned round, and half the correlation."""
    return 0.5 * (1.0 - F.least(nrmse(y, p), F.lit(1.0))) + 0.5 * pearson_clipped(y, p)


def accuracy(y, p) -> Column:
    return F.avg((_c(y) == _c(p)).cast("double"))


def f1_binary(y, p, positive=1) -> Column:
    yy, pp = _c(y) == F.lit(positive), _c(p) == F.lit(positive)
    tp = F.count(F.when(yy & pp, 1)).cast("double")
    wrong = F.count(F.when(yy != pp, 1))
    return F.when(tp + wrong == 0, F.lit(0.0)).otherwise(2.0 * tp / (2.0 * tp + wrong))


def binary_cross_entropy(y, prob, eps: float = EPS) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), _c(prob)))
    return -F.avg(_c(y) * F.ln(q) + (1 - _c(y)) * F.ln(1.0 - q))


def log_loss(y, probs, eps: float = EPS) -> Column:
    """Mean -ln of the probability given to the true class (0-based index into `probs`)."""
    q = F.element_at(_c(probs), (_c(y) + 1).cast("int"))
    return -F.avg(F.ln(F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), q))))


def categorical_cross_entropy(onehot, probs, eps: float = EPS) -> Column:
    """The same loss for a one-hot target."""
    parts = F.zip_with(_c(onehot), _c(probs), lambda t, q: t.cast("double") * F.ln(
        F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), q))))
    return -F.avg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def f1_per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """tp, fp, fn and F1 of each class met as truth or prediction."""
    cells = df.groupBy(F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.col("_y") == F.col("_p")
    sides = F.when(hit, F.array(F.struct(F.col("_y").alias("class"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))
                   ).otherwise(F.array(
                       F.struct(F.col("_y").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")),
                       F.struct(F.col("_p").alias("class"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))))
    flat = cells.select("_n", F.inline(sides))
    sums = flat.groupBy("class").agg(*[F.sum(F.col(c) * F.col("_n")).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumn("f1", 2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fp") + F.col("fn")))


def f1_macro(df: DataFrame, y: str, p: str) -> DataFrame:
    return f1_per_class(df, y, p).agg(F.avg("f1").alias("f1_macro"))


def roc_auc_per_class(df: DataFrame, y: str, scores: dict) -> DataFrame:
    """One-vs-rest area under the ROC curve of each class; ties count half.

    Rows are first reduced to (class, score) counts; the running count of negatives is
    taken over range slices of that table, never over one class in one task.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("class"), _c(c).cast("double").alias("score"))
                      for k, c in scores.items()])
    long = df.select(F.col(y).alias("_y"), F.inline(pairs))
    own = F.col("_y") == F.col("class")
    steps = long.groupBy("class", "score").agg(
        F.count(F.when(own, 1)).alias("pos"), F.count(F.when(~own, 1)).alias("neg"))
    ranked = prefix_sum(steps, {"neg_upto": F.col("neg")}, "score", ["class"])
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0)
    return ranked.groupBy("class").agg(
        (F.sum(wins) / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("auc"))


def roc_auc_macro(df: DataFrame, y: str, scores: dict) -> DataFrame:
    return roc_auc_per_class(df, y, scores).agg(F.avg("auc").alias("auc_macro"))


def fold_scores(df: DataFrame, fold: str, metric: Column, name: str = "score") -> DataFrame:
    return df.groupBy(fold).agg(metric.alias(name))


def mean_fold_score(scores: DataFrame, name: str = "score", digits: int = 4) -> DataFrame:
    return scores.agg(F.bround(F.avg(name), digits).alias(f"mean_{name}"))


def score_table(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Several aggregate metrics in one pass, one row."""
    return df.agg(*[m.alias(n) for n, m in metrics.items()])
