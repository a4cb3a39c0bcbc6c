"""User functions: per column, per row with several results, one row to many, as a metric."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_column(df: DataFrame, col: str, fn: Callable[[pd.Series], pd.Series] | Callable[[Column], Column],
               returns: str | None = None, out: str | None = None) -> DataFrame:
    """Apply `fn` to a column: a column expression, or a pandas function if `returns` names its type."""
    expr = fn(F.col(col)) if returns is None else F.pandas_udf(fn, returns)(F.col(col))
    return df.withColumn(out or col, expr)


def row_features(df: DataFrame, fn: Callable[..., pd.DataFrame], inputs: Sequence[str], returns: str) -> DataFrame:
    """Add several named columns computed together from `inputs`, batch by batch."""
    made = F.pandas_udf(fn, returns)(*[F.col(c) for c in inputs])
    return df.withColumn("_made", made).select(*df.columns, "_made.*")


def one_to_many(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Each input batch to any number of rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)
    return df.mapInPandas(run, schema)


def user_metrics(df: DataFrame, y: str, p: str, metrics: Mapping[str, Callable[[str, str], Column]],
                 by: Sequence[str] = ()) -> DataFrame:
    """Own metrics written as aggregate expressions over (y, p), in one pass, per group if asked."""
    exprs = [fn(y, p).alias(name) for name, fn in metrics.items()]
    return df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
