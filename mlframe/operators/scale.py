"""Scalers with exact statistics: a fit is one aggregate, a transform is plain arithmetic.

Fitted parameters are `{column: (shift, divisor)}`; scaled = (x - shift) / divisor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.operators.ordering import md5_int
from mlframe.operators.quantiles import exact_quantiles

Params = dict[str, tuple[float, float]]


def _stats(df: DataFrame, cols: Sequence[str], **aggs) -> dict[str, dict[str, float]]:
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}__{c}") for c in cols for n, f in aggs.items()]).first()
    return {c: {n: row[f"{n}__{c}"] for n in aggs} for c in cols}


def _divisor(x: float | None) -> float:
    return 1.0 if not x else float(x)  # a constant column is only shifted


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> Params:
    s = _stats(df, cols, lo=F.min, hi=F.max)
    return {c: (v["lo"], _divisor(v["hi"] - v["lo"])) for c, v in s.items()}


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Params:
    """Mean and population deviation."""
    s = _stats(df, cols, mean=F.avg, std=F.stddev_pop)
    return {c: (v["mean"], _divisor(v["std"])) for c, v in s.items()}


def fit_maxabs(df: DataFrame, cols: Sequence[str]) -> Params:
    s = _stats(df, cols, top=lambda c: F.max(F.abs(c)))
    return {c: (0.0, _divisor(v["top"])) for c, v in s.items()}


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Params:
    """Median and interquartile range, both exact."""
    return {c: (q[1], _divisor(q[2] - q[0])) for c, q in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).items()}


FITTERS = {"minmax": fit_minmax, "standard": fit_standard, "maxabs": fit_maxabs, "robust": fit_robust}


def apply_scale(df: DataFrame, params: Params) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in params.items()})


def inverse_scale(df: DataFrame, params: Params) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(b) + F.lit(a) for c, (a, b) in params.items()})


def scale(df: DataFrame, cols: Sequence[str], how: str, fit_on: DataFrame | None = None) -> DataFrame:
    return apply_scale(df, FITTERS[how](df if fit_on is None else fit_on, cols))


def minmax_scale(df, cols, fit_on=None):
    return scale(df, cols, "minmax", fit_on)


def standard_scale(df, cols, fit_on=None):
    return scale(df, cols, "standard", fit_on)


def maxabs_scale(df, cols, fit_on=None):
    return scale(df, cols, "maxabs", fit_on)


def robust_scale(df, cols, fit_on=None):
    return scale(df, cols, "robust", fit_on)


def global_standardize(df: DataFrame, arr: str, out: str | None = None) -> DataFrame:
    """One mean and one sample deviation over all cells of an array column."""
    x = F.col("x").cast("double")
    mean, std = df.select(F.explode(arr).alias("x")).agg(F.avg(x), F.stddev_samp(x)).first()
    return df.withColumn(out or arr, F.transform(
        arr, lambda x: (x.cast("double") - F.lit(mean)) / F.lit(_divisor(std))))


def add_noise(df: DataFrame, arr: str, sigma: float, seed: int, key: str, lo: float = 0.0, hi: float = 1.0,
              out: str | None = None) -> DataFrame:
    """Gaussian noise on each cell, then a clip to lo..hi.

    Each cell's draw comes from md5 of (seed, row key, place) through the Box-Muller
    formula, so a recomputed task gives the same noise.
    """
    def uniform(place, salt):
        return (md5_int(F.lit(seed), F.col(key), place, F.lit(salt)) + F.lit(0.5)) / F.lit(1152921504606846976.0)

    def noisy(x, i):
        normal = F.sqrt(F.lit(-2.0) * F.ln(uniform(i, 0))) * F.cos(F.lit(6.283185307179586) * uniform(i, 1))
        return F.greatest(F.lit(lo), F.least(F.lit(hi), x.cast("double") + F.lit(sigma) * normal))

    return df.withColumn(out or arr, F.transform(arr, noisy))
