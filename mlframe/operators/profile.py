"""Table profiles: sizes, types, summaries, counts, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.operators.quantiles import exact_quantiles


def _long(df: DataFrame, per_column: dict[str, list], names: Sequence[str]) -> DataFrame:
    """One aggregate pass, then one output row per column."""
    aggs = [e.alias(f"{c}__{n}") for c, es in per_column.items() for n, e in zip(names, es)]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              *[F.col(f"{c}__{n}").alias(n) for n in names]) for c in per_column])
    return df.agg(*aggs).select(F.inline(rows))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def info(df: DataFrame) -> DataFrame:
    """Non-null count and type of each column."""
    return _long(df, {f.name: [F.count(f.name), F.lit(f.dataType.simpleString())] for f in df.schema.fields},
                 ["non_null", "type"])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, exact quartiles and max of each numeric column."""
    cols = list(cols or numeric_columns(df))
    quarts = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    per = {}
    for c in cols:
        v = F.col(c).cast("double")
        q1, q2, q3 = (F.lit(q).cast("double") for q in quarts[c])
        per[c] = [F.count(c), F.avg(v), F.stddev_samp(v), F.min(v),
                  F.first(q1), F.first(q2), F.first(q3), F.max(v)]
    return _long(df, per, ["n", "mean", "std", "min", "q25", "q50", "q75", "max"])


def null_counts(df: DataFrame) -> DataFrame:
    return _long(df, {c: [F.count(F.when(F.col(c).isNull(), 1))] for c in df.columns}, ["missing"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Most frequent first, ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))


def unique_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with their counts, by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    return counts.withColumn("weight", F.lit(float(total)) / (F.lit(float(classes)) * F.col("n")))


def length_profile(df: DataFrame, arr: str) -> DataFrame:
    size = F.size(arr)
    return df.agg(F.max(size).alias("max_len"), F.min(size).alias("min_len"), F.avg(size).alias("mean_len"))


def array_range(df: DataFrame, arr: str) -> DataFrame:
    return df.agg(F.min(F.array_min(arr)).alias("min_value"), F.max(F.array_max(arr)).alias("max_value"))
