"""End-to-end recipes: from a raw table to scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.functions import metrics
from mlframe.operators import clean, encode, models, split, text


def calendar_regression(df: DataFrame, key: str, ts: str, target: str, test_size: float = 0.2, seed: int = 0,
                        name: str = "linear") -> tuple[PipelineModel, DataFrame]:
    """Calendar features of a timestamp explain a number. Returns (model, scored test rows)."""
    ready = encode.calendar_features(df.select(key, ts, target), ts)
    cols = [c for c in ready.columns if c not in (key, target)]
    train, test = split.train_test_split(ready, key, test_size, seed)
    model = models.chain(models.assembler(cols), models.estimator("regression", name, target)).fit(train)
    return model, models.batch_score(model, test, [key, target])


def regression_reports(scored: DataFrame, target: str, forms: Mapping[str, str]) -> DataFrame:
    """The regression report of several predicted columns, named in `form`, from one pass over the rows."""
    kinds = {"rmse": metrics.rmse, "r2": metrics.r2, "mae": metrics.mae}
    cells = {f"{m}_{i}": f(target, c) for i, c in enumerate(forms.values()) for m, f in kinds.items()}
    wide = metrics.score_table(scored, {"n": F.count(F.lit(1)), **cells})
    rows = [F.struct("n", *[F.col(f"{m}_{i}").alias(m) for m in kinds], F.lit(form).alias("form")) for i, form in enumerate(forms)]
    return wide.select(F.inline(F.array(*rows)))


def regression_report(scored: DataFrame, target: str) -> DataFrame:
    return metrics.score_table(scored, {
        "n": F.count(F.lit(1)), "rmse": metrics.rmse(target, "prediction"), "r2": metrics.r2(target, "prediction"),
        "mae": metrics.mae(target, "prediction")})


def text_classification(df: DataFrame, key: str, texts: Sequence[str], label: str, num_words: int | None = None,
                        test_size: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Merged text, vocabulary, id sequences, word-count vectors, logistic fit, 0.5 threshold.

    All words count unless `num_words` caps them. Returns (scored test rows, one-row report with F1, accuracy and vocabulary size).
    """
    merged = encode.merge_text(df, texts, " ", lower=[texts[-1]], out="_text").select(key, "_text", label)
    vocab = text.build_vocab(merged, "_text", key)
    known = text.cap_vocab(vocab, num_words) if num_words else vocab
    seqs = text.texts_to_sequences(merged, "_text", [key, label], known)  # the label goes along, not back by a join
    width = text.vocab_size(known).first()[0] or 1
    ready = text.bag_of_words(seqs, "seq", [key, label], width)  # stored: read by the split, the fit and the scores
    train, test = split.train_test_split(ready, key, test_size, seed)
    if width <= models.WIDE:  # beyond, the fit stores the rows its own way
        train.persist()
    model = models.estimator("classification", "logistic", label, width=width, maxIter=20, regParam=0.01).fit(train)
    train.unpersist()
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(test).withColumn("score", vector_to_array("prediction_prob")[1])
    scored = clean.binarize(scored.select(key, label, "score"), "score", 0.5, "prediction")
    size = text.vocab_size(vocab).first()[0]
    report = metrics.score_table(scored, {
        "n": F.count(F.lit(1)), "f1": metrics.f1_binary(label, "prediction"),
        "accuracy": metrics.accuracy(label, "prediction"), "vocab_size": F.first(F.lit(size))})
    return scored, report
