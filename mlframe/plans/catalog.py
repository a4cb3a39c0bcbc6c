"""Registry of the checked queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.sources import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register `fn(t)` under its name; `t('orders')` loads a table of the given folder."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return register


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, *cols: str) -> DataFrame:
        return load_table(self.spark, self.folder, name, cols)

    def spread(self, name: str, *cols: str) -> DataFrame:
        return load_table(self.spark, self.folder, name, cols, spread=True)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def cells(df: DataFrame, arr: str, *keep: str) -> DataFrame:
    """Array cells in long form, comparable value by value."""
    return df.select(*keep, F.posexplode(arr).alias("pos", "cell"))
