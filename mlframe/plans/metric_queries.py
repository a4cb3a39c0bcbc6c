"""Evaluation numbers (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlframe.functions import arrays, metrics
from mlframe.operators import split
from mlframe.plans.catalog import query, r6

# A pseudo-prediction of the line price, and of a second target, from other columns.
_LINES = "(SELECT *, l_quantity * 2100::DOUBLE + 50 AS p, l_tax * 10 + l_discount AS p2, l_discount * 5 AS y2, l_extendedprice AS y FROM lineitem)"


def _lines(t):
    return t("lineitem").select("*", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100.0 + 50).alias("p"),
                                (F.col("l_discount") * 5).alias("y2"), (F.col("l_tax") * 10 + F.col("l_discount")).alias("p2"))


# Ten class scores of a row: a softmax over the sums of its cells by position modulo ten; the prediction is the best class.
_SCORES = """sc AS (SELECT vec_id, label, [list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(1, len(embedding) + 1) IF i % 10 = (c + 1) % 10]) FOR c IN range(10)] AS v FROM embeddings),
ex AS (SELECT vec_id, label, v, list_transform(v, lambda x: exp(10 * x)) AS e FROM sc),
pr AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS probs, list_position(v, list_max(v)) - 1 AS pred FROM ex)"""


def _scores(t):
    wide = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    e = F.transform(arrays.sums_by_position("x", 10), lambda s: F.exp(s * 10))
    df = wide.withColumn("e", e)
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("probs", F.transform("e", lambda x: x / total))
    return df.select("vec_id", "label", "probs", arrays.argmax("e").alias("pred"))


def _one(df, **named):
    return metrics.score_table(df, {n: r6(m) for n, m in named.items()})


@query(f"SELECT round(avg(pow(y - p, 2)), 2) AS mse FROM {_LINES}")
def mean_squared_error(t):
    """M1."""
    return metrics.score_table(_lines(t), {"mse": F.round(metrics.mse("y", "p"), 2)})


@query(f"SELECT round(sqrt(avg(pow(y - p, 2))), 4) AS rmse FROM {_LINES}")
def root_mean_squared_error(t):
    """M2."""
    return metrics.score_table(_lines(t), {"rmse": F.round(metrics.rmse("y", "p"), 4)})


@query(f"""
SELECT round(1 - sum(pow(y - p, 2)) / (SELECT sum(pow(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem), 2)) FROM lineitem), 6) AS r2,
       round((2 - sum(pow(y - p, 2)) / (SELECT sum(pow(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem), 2)) FROM lineitem)
                - sum(pow(y2 - p2, 2)) / (SELECT sum(pow(l_discount * 5 - (SELECT avg(l_discount * 5) FROM lineitem), 2)) FROM lineitem)) / 2, 6) AS r2_two
FROM {_LINES}
""")
def r_squared(t):
    """M3: one target, and the mean over two."""
    return _one(_lines(t), r2=metrics.r2("y", "p"), r2_two=metrics.r2_multi(["y", "y2"], ["p", "p2"]))


@query(f"SELECT round(avg(abs(y - p)), 4) AS mae FROM {_LINES}")
def mean_absolute_error(t):
    """M4."""
    return metrics.score_table(_lines(t), {"mae": F.round(metrics.mae("y", "p"), 4)})


@query(f"""
SELECT round(avg(CASE WHEN abs(y2 - p2) <= 0.2 THEN 0.5 * pow(y2 - p2, 2) ELSE 0.2 * abs(y2 - p2) - 0.5 * 0.2 * 0.2 END), 6) AS huber_small,
       round(avg(CASE WHEN abs(y - p) <= 1 THEN 0.5 * pow(y - p, 2) ELSE abs(y - p) - 0.5 END), 4) AS huber FROM {_LINES}
""")
def huber_loss(t):
    """M5."""
    return metrics.score_table(_lines(t), {
        "huber": F.round(metrics.huber("y", "p"), 4), "huber_small": r6(metrics.huber("y2", "p2", 0.2))})


@query(f"SELECT round(sqrt(avg(pow(y - p, 2))) / (max(y) - min(y)), 6) AS nrmse FROM {_LINES}")
def range_normalised_rmse(t):
    """M6."""
    return _one(_lines(t), nrmse=metrics.nrmse("y", "p"))


@query(f"SELECT round(greatest(0, least(1, corr(y, p))), 6) AS pearson, round(greatest(0, least(1, corr(y, -p))), 6) AS clipped FROM {_LINES}")
def clipped_correlation(t):
    """M7."""
    df = _lines(t).withColumn("minus", -F.col("p"))
    return _one(df, pearson=metrics.pearson_clipped("y", "p"), clipped=metrics.pearson_clipped("y", "minus"))


@query(f"""
SELECT round(0.5 * (1 - least(sqrt(avg(pow(y - p, 2))) / (max(y) - min(y)), 1)) + 0.5 * greatest(0, least(1, corr(y, p))), 6) AS score FROM {_LINES}
""")
def composite_score(t):
    """M8."""
    return _one(_lines(t), score=metrics.composite_score("y", "p"))


@query(f"WITH {_SCORES} SELECT round(avg(CAST(label = pred AS INTEGER)), 6) AS accuracy, round(avg(CAST(label = pred AS INTEGER)) FILTER (label IN (0, 6)), 6) AS accuracy_two FROM pr")
def accuracy(t):
    """M9: over all rows, and over two labels."""
    df = _scores(t)
    hit = F.when(F.col("label").isin(0, 6), (F.col("label") == F.col("pred")).cast("double"))
    return _one(df, accuracy=metrics.accuracy("label", "pred"), accuracy_two=F.avg(hit))


@query(f"""
WITH {_SCORES}, k AS (SELECT DISTINCT label AS c FROM pr UNION SELECT DISTINCT pred FROM pr),
f AS (SELECT c, 2.0::DOUBLE * count(*) FILTER (label = c AND pred = c) / (count(*) FILTER (label = c) + count(*) FILTER (pred = c)) AS f1 FROM k, pr GROUP BY c)
SELECT round(avg(f1), 6) AS f1_macro FROM f
""")
def f1_macro(t):
    """Mean over classes."""
    return metrics.f1_macro(_scores(t), "label", "pred").withColumn("f1_macro", r6("f1_macro"))


@query("""
SELECT round(2.0::DOUBLE * count(*) FILTER (y AND p) / (count(*) FILTER (y) + count(*) FILTER (p)), 6) AS f1
FROM (SELECT l_returnflag = 'R' AS y, l_quantity > 25 AS p FROM lineitem)
""")
def f1_binary(t):
    """M10."""
    df = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"))
    return _one(df, f1=metrics.f1_binary("y", "p"))


@query(f"WITH {_SCORES} SELECT round(-avg(ln(probs[label + 1])), 6) AS log_loss FROM pr")
def log_loss(t):
    """M11."""
    return _one(_scores(t), log_loss=metrics.log_loss("label", "probs"))


@query(f"""
WITH {_SCORES}, l AS (SELECT c, label = c AS own, probs[c + 1] AS s FROM (SELECT label, probs, unnest(range(10)) AS c FROM pr)),
r AS (SELECT c, own, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0::DOUBLE AS rk FROM l),
a AS (SELECT c, (sum(rk) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0::DOUBLE)
             / (count(*) FILTER (own) * count(*) FILTER (NOT own)) AS auc FROM r GROUP BY c)
SELECT c AS class, round(auc, 6) AS auc, round((SELECT avg(auc) FROM a), 6) AS auc_macro FROM a
""")
def roc_auc(t):
    """One-vs-rest per class and their mean."""
    df = _scores(t)
    per = metrics.roc_auc_per_class(df, "label", {c: F.element_at("probs", c + 1) for c in range(10)})
    macro = per.agg(F.avg("auc")).first()[0]
    return per.select("class", r6("auc").alias("auc"), r6(F.lit(macro)).alias("auc_macro"))


@query("""
WITH l AS (SELECT l_linestatus = 'O' AS own, l_quantity AS s FROM lineitem),
r AS (SELECT own, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM l)
SELECT round((sum(rk) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0::DOUBLE)
             / (CAST(count(*) FILTER (own) AS DOUBLE) * count(*) FILTER (NOT own)), 6) AS auc FROM r
""")
def roc_auc_with_ties(t):
    """Many equal scores."""
    out = metrics.roc_auc_per_class(t("lineitem"), "l_linestatus", {"O": "l_quantity"})
    return out.select(r6("auc").alias("auc"))


@query(f"""
WITH {_SCORES} SELECT round(-avg(ln(probs[label + 1])), 6) AS categorical,
  round(-avg(CASE WHEN label = 0 THEN ln(probs[1]) ELSE ln(1 - probs[1]) END), 6) AS binary FROM pr
""")
def cross_entropies(t):
    """One-hot and binary targets."""
    df = _scores(t).select(arrays.one_hot_vector("label", 10).alias("hot"), "probs",
                           (F.col("label") == 0).cast("int").alias("y"), F.element_at("probs", 1).alias("q"))
    return _one(df, categorical=metrics.categorical_cross_entropy("hot", "probs"), binary=metrics.binary_cross_entropy("y", "q"))


_FOLDED = """r AS (SELECT *, row_number() OVER (ORDER BY md5('2:' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders),
fd AS (SELECT *, CASE WHEN rn <= (n % 5) * (n // 5 + 1) THEN (rn - 1) // (n // 5 + 1) ELSE n % 5 + (rn - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM r)"""


@query(f"WITH {_FOLDED} SELECT fold, round(sqrt(avg(pow(o_totalprice - 250000, 2))), 4) AS score FROM fd GROUP BY fold")
def fold_scores(t):
    """One score per fold."""
    return _fold_scores(t).withColumn("score", F.round("score", 4))


@query(f"WITH {_FOLDED} SELECT round_even(avg(s), 4) AS mean_score FROM (SELECT sqrt(avg(pow(o_totalprice - 250000, 2))) AS s FROM fd GROUP BY fold)")
def fold_score_mean(t):
    """Their rounded mean."""
    return metrics.mean_fold_score(_fold_scores(t))


def _fold_scores(t):
    df = split.kfold(t("orders", "o_orderkey", "o_totalprice"), "o_orderkey", 5, 2).withColumn("p", F.lit(250000.0))
    return metrics.fold_scores(df, "fold", metrics.rmse("o_totalprice", "p"))
