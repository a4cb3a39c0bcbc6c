"""Projections, filters and missing-value handling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.operators.ordering import as_list, global_index
from mlframe.operators.profile import numeric_columns
from mlframe.operators.quantiles import exact_quantiles
from mlframe.operators.ranks import cut_after, rank_keys
from mlframe.sources.files import normalize_missing

__all__ = ["binarize", "cast_numeric", "clip", "compact_column", "dedupe_first", "drop_columns", "drop_missing",
           "fill_constant", "filter_remap", "filter_valid", "finite_or", "head_n", "impute", "infer_target",
           "invert_mapping", "normalize_missing", "remap", "round_half_even", "sentinel_to_null", "shift_label",
           "slice_rows", "split_xy", "time_range", "zscore_filter"]


def _replace(df: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(changed)) if changed else df


def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*as_list(cols))


def split_xy(df: DataFrame, target, drop: Sequence[str] = (), key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(features, targets); `key` columns stay on both sides, so no row order is needed."""
    key, target = as_list(key), as_list(target)
    return df.drop(*target, *drop), df.select(*key, *target)


def infer_target(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate that is a column, else the last column."""
    return next((c for c in candidates if c in df.columns), df.columns[-1])


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)


def impute(df: DataFrame, cols: Sequence[str], how: str = "mean", fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing values with the mean or exact median of `fit_on` (default: `df`)."""
    source = df if fit_on is None else fit_on
    if how == "mean":
        fill = source.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif how == "median":
        fill = {c: q[0] for c, q in exact_quantiles(source, cols, [0.5]).items()}
    else:
        raise ValueError(f"unknown imputation {how!r}")
    return _replace(df, {c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in cols})


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def sentinel_to_null(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    """`value` means missing: in the named columns, or in all numeric ones."""
    return _replace(df, {c: F.nullif(F.col(c), F.lit(value)) for c in (cols or numeric_columns(df))})


def finite_or(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """NaN and infinities become `value`."""
    def fixed(c):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(value)).otherwise(F.col(c))
    return _replace(df, {c: fixed(c) for c in cols})


def zscore_filter(df: DataFrame, cols: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Rows within `limit` population deviations in every column; all rows if none qualifies."""
    fit = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    keep = F.lit(True)
    for c in cols:
        mean, std = fit[f"m_{c}"], fit[f"s_{c}"]
        if std:  # a constant column has z = 0 everywhere
            keep = keep & (F.abs((F.col(c) - F.lit(mean)) / F.lit(std)) < limit)
    kept = df.filter(keep)
    return df if kept.isEmpty() else kept


def dedupe_first(df: DataFrame, subset, order_by) -> DataFrame:
    """The first row, by `order_by`, of each `subset` value.

    An aggregate with map-side combine: a value shared by very many rows costs one
    partial result per task.
    """
    subset, order_by = as_list(subset), as_list(order_by)
    first = F.min_by(F.struct(*df.columns), F.struct(*order_by)).alias("_first")
    return df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in subset]).agg(first).select("_first.*")


def remap(df: DataFrame, label: str, mapping: Mapping) -> DataFrame:
    """Replace labels through a small literal mapping; others become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(label, F.create_map(*pairs)[F.col(label)])


def filter_remap(df: DataFrame, label: str, mapping: Mapping) -> DataFrame:
    """Keep the mapped labels only, renumbered."""
    return remap(df.filter(F.col(label).isin(list(mapping))), label, mapping)


def invert_mapping(mapping: Mapping) -> dict:
    return {v: k for k, v in mapping.items()}


def shift_label(df: DataFrame, label: str, by: int = -1) -> DataFrame:
    return df.withColumn(label, F.col(label) + F.lit(by))


def time_range(df: DataFrame, ts: str, lo: datetime, hi: datetime) -> DataFrame:
    """Rows with lo <= ts <= hi; the bounds reach the scan as pushed filters."""
    kind = df.schema[ts].dataType
    return df.filter(F.col(ts).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))


def compact_column(df: DataFrame, col: str, order_by, n: int) -> DataFrame:
    """Blank the first `n` values of `col`, then move the non-null ones up; the tail is null."""
    rows = global_index(df, order_by, "_row")
    values = rows.filter((F.col("_row") > n) & F.col(col).isNotNull()).select("_row", F.col(col).alias("_value"))
    moved = global_index(values, "_row", "_place").select(F.col("_place"), "_value")
    joined = rows.join(moved, rows["_row"] == moved["_place"], "left")
    return joined.select(*[F.col("_value").alias(c) if c == col else F.col(c) for c in df.columns])


def slice_rows(df: DataFrame, order_by, lo: int = 0, hi: int | None = None) -> DataFrame:
    """Rows lo..hi-1 (0-based) in the given order; a negative bound counts from the end."""
    def bounds(n):
        first = max(0, n + lo) if lo < 0 else lo
        last = n if hi is None else n + hi if hi < 0 else hi
        return first, last

    order, n, found = rank_keys(df, order_by, bounds)
    first, last = bounds(n)
    upto = F.lit(True) if last >= n else order.upto(df, found.get(last))
    after = F.lit(True) if first <= 0 else F.lit(False) if first >= n else ~order.upto(df, found.get(first))
    return df.filter(upto & after)


def head_n(df: DataFrame, order_by, n: int) -> DataFrame:
    """The first n rows, in no particular order."""
    return cut_after(df, order_by, n)[0]


def round_half_even(df: DataFrame, cols: Sequence[str], digits: int = 0) -> DataFrame:
    """Nearest value, ties to even."""
    def rounded(c):
        return F.rint(c) if digits == 0 else F.bround(c, digits)
    return _replace(df, {c: rounded(c) for c in cols})


def binarize(df: DataFrame, score: str, threshold: float = 0.5, out: str | None = None) -> DataFrame:
    return df.withColumn(out or score, (F.col(score) > F.lit(threshold)).cast("int"))


def cast_numeric(df: DataFrame, cols: Sequence[str], kind: str = "float") -> DataFrame:
    return _replace(df, {c: F.col(c).cast(kind) for c in cols})


def clip(df: DataFrame, cols: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Limit values, or the cells of array columns, to lo..hi."""
    def clipped(c):
        if isinstance(df.schema[c].dataType, T.ArrayType):
            return F.transform(c, lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
        return F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c))))
    return _replace(df, {c: clipped(c) for c in cols})


def filter_valid(df: DataFrame, predicate: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Rows for which a column predicate (or a boolean pandas UDF column) is true."""
    return df.filter(predicate(df) if callable(predicate) and not isinstance(predicate, Column) else predicate)
