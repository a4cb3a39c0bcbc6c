"""Helpers shared by the operators on numeric vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import fresh

#: A table of group totals is broadcast up to this size, else both sides are dealt out by group and salt.
BROADCAST_BYTES = 8 << 20
SALTS = 32


def floored(vector: str | Column, scale: int, most: int) -> Column:
    """floor(scale * x) of each component, x as double, held within -most..most; null unless the vector is whole and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    cell = lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * scale)))
    return F.when(fine & (F.size(v) > 0), F.transform(v, cell))


def common_length(v: DataFrame, column: str = "v") -> int:
    """The length that most vectors have, the larger one of two equally frequent; 0 for an empty table."""
    sizes = v.select(F.size(column).alias("n")).groupBy("n").count()
    first = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else 0


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as one array, without a copy per row."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def summed_rows(df: DataFrame, keys: list[str], values: str, width: int, kind: str) -> DataFrame:
    """Arrays `values` added up cell by cell per key (cells beyond an array's end count as nothing), as columns s0, s1, ..."""
    cells = [F.sum(F.get(values, F.lit(i)).cast(kind)).alias(f"s{i}") for i in range(width)]
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), *cells)


def with_group_total(df: DataFrame, group: str, value: str, out: str, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with the sum of the long `value` over rows of equal `group` (nulls are equal); sums stop at the largest long.

    Groups are summed before anything moves. Their table is broadcast if its size allows, else a group's rows are
    dealt out over SALTS keys, so that one group with a third of all rows is no single task.
    """
    g, t, s = fresh(df, "g_key"), fresh(df, "g_total"), fresh(df, "g_salt")
    total = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    totals = stored(df.groupBy(F.col(group).alias(g)).agg(total.alias(t)))
    n, size = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col(g).cast("string"))), F.lit(0))).first()
    same = F.col(group).eqNullSafe(F.col(g))
    if 48 * n + size <= BROADCAST_BYTES:
        joined = df.join(F.broadcast(totals), same)
    else:
        salted = df.withColumn(s, F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        o = fresh(salted, "g_other")
        dealt = totals.withColumn(o, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(dealt, same & (F.col(s) == F.col(o)))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.col(t).alias(out))
