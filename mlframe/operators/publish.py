"""Ranking, sorting, running totals and putting predictions into their template."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlframe.operators.ordering import as_list, prefix_sum


def rank_results(df: DataFrame, score: str, out: str = "rank") -> DataFrame:
    """Competition rank, best (largest) score first: equal scores share a rank.

    Ranks come from running counts over the distinct scores, so the table itself is
    never sorted in one task.
    """
    sizes = df.groupBy(F.col(score).alias("_score")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix_sum(sizes, {"_upto": F.col("_n")}, [F.col("_score").desc()])
    table = ranked.select("_score", (F.col("_upto") - F.col("_n") + 1).alias(out))
    return df.join(table, F.col(score).eqNullSafe(F.col("_score"))).drop("_score")


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, ascending) pairs."""
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys])


def top_per_group(df: DataFrame, group, order_by, n: int = 3) -> DataFrame:
    """The first n rows of each group; each task keeps n rows per group before the shuffle."""
    w = Window.partitionBy(*as_list(group)).orderBy(*as_list(order_by))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def running_sum(df: DataFrame, value: str, order_by, out: str = "running", partition_by: Sequence[str] = ()) -> DataFrame:
    return prefix_sum(df, {out: F.col(value)}, order_by, partition_by)


def sorted_thresholds(df: DataFrame, value: str) -> DataFrame:
    """Distinct values in ascending order."""
    return df.select(value).distinct().orderBy(value)


def submit(template: DataFrame, predictions: DataFrame, key, cols: Mapping[str, str]) -> DataFrame:
    """The template's rows with predictions matched by key; `cols` maps target to prediction column."""
    key = as_list(key)
    given = predictions.select(*key, *[F.col(p).alias(f"_p_{t}") for t, p in cols.items()])
    joined = template.join(given, key, "left")
    kept = [F.col(f"_p_{c}").alias(c) if c in cols else F.col(c) for c in template.columns]
    added = [F.col(f"_p_{t}").alias(t) for t in cols if t not in template.columns]
    return joined.select(*kept, *added)


def append_columns(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """Generated columns side by side; the rows are the same, so no join is needed."""
    return df.withColumns(dict(named))


def union_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """All values of one column from two tables, duplicates kept."""
    return a.select(col).unionAll(b.select(col))


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct()


def label_count(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_distinct(label).alias("n_labels"))
