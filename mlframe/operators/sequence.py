"""Sliding windows and shifted targets over ordered tables.

A table is one series, or one per `partition_by` value. Rows are ordered once, in blocks that hold the rows
behind them (see `halo`), so a single series that holds most rows is still spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlframe.operators.halo import BLOCK_ROWS, look_ahead, value_at, windows_of
from mlframe.operators.ordering import as_list, global_index
from mlframe.operators.ranks import cut_after

CHUNK_ROWS = BLOCK_ROWS


def sliding_windows(df: DataFrame, cols: Sequence[str], order_by, timesteps: int, stride: int = 1,
                    partition_by: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Full windows of `timesteps` rows, one every `stride` rows, as one array column per input.

    Keeps the columns of the window's first row and adds `step`, its 1-based place. All columns of `df` are ordered and
    written once, so select the needed ones first.
    """
    made = [(f"{c}_window", T.ArrayType(df.schema[c].dataType), windows_of(df.columns.index(c), timesteps)) for c in cols]
    return _look_ahead(df, order_by, partition_by, timesteps - 1, made, stride, chunk_rows)


def _look_ahead(df: DataFrame, order_by, partition_by, ahead: int, made, stride: int, chunk_rows: int) -> DataFrame:
    """`made`: (name, type, function) of each added column."""
    makers = [m for _, _, m in made]
    fields = [T.StructField(n, t) for n, t, _ in made]
    return look_ahead(df, order_by, partition_by, ahead, lambda rows, at: [m(rows, at) for m in makers], fields, stride, chunk_rows)


def window_xy(df: DataFrame, arr: str, x: str = "x", y: str = "y") -> DataFrame:
    """All but the last step of a window as x, the last as y."""
    return df.withColumns({x: F.slice(arr, F.lit(1), F.size(arr) - 1), y: F.element_at(arr, -1)})


def window_seq2seq(df: DataFrame, features: str, target: str, horizon: int, x: str = "x", y: str = "y") -> DataFrame:
    """The first `horizon` steps of the feature window and the last `horizon` of the target window."""
    return df.withColumns({x: F.slice(features, 1, horizon), y: F.slice(target, -horizon, horizon)})


def hold_out_tail(df: DataFrame, step: str, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(training windows, forecast window): the last `horizon` windows are held out, the very last forecasts."""
    first, last, count = df.agg(F.min(step), F.max(step), F.count(step)).first()
    if count <= horizon:
        raise ValueError(f"{count} windows cannot hold out {horizon}")
    stride = 1 if count < 2 else (last - first) // (count - 1)
    return df.filter(F.col(step) <= last - stride * horizon), df.filter(F.col(step) == last)


def lead_target(df: DataFrame, col: str, n: int, order_by, partition_by: Sequence[str] = (), out: str | None = None,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The value `n` rows ahead; rows without one are dropped."""
    made = [(out or f"{col}_ahead", df.schema[col].dataType, value_at(df.columns.index(col), n))]
    return _look_ahead(df, order_by, partition_by, n, made, 1, chunk_rows)


def window_horizon(df: DataFrame, cols: Sequence[str], target: str, order_by, timesteps: int, offset: int = 1,
                   stride: int = 1, partition_by: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Windows with the target's value `offset` rows after the window's last row (1 = next row)."""
    ahead = timesteps + offset - 1
    made = [(f"{c}_window", T.ArrayType(df.schema[c].dataType), windows_of(df.columns.index(c), timesteps)) for c in cols]
    made.append(("target", df.schema[target].dataType, value_at(df.columns.index(target), ahead)))
    return _look_ahead(df, order_by, partition_by, ahead, made, stride, chunk_rows)


def window_next(df: DataFrame, cols: Sequence[str], target: str, order_by, timesteps: int,
                partition_by: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Windows with the target of the row after them."""
    return window_horizon(df, cols, target, order_by, timesteps, 1, 1, partition_by, chunk_rows)


def score_tail(actual: DataFrame, predicted: DataFrame, n: int, order_by, actual_col: str, predicted_col: str) -> DataFrame:
    """RMSE of the last `n` rows of both tables, matched by position from the end."""
    def tail(df, col, out):
        last = cut_after(df.select(*as_list(order_by), F.col(col).alias(out)), order_by, lambda rows: rows - n)[1]
        return global_index(last, [F.col(c).desc() for c in as_list(order_by)], "_from_end").select("_from_end", out)

    pair = tail(actual, actual_col, "_a").join(tail(predicted, predicted_col, "_p"), "_from_end")
    err = F.col("_a").cast("double") - F.col("_p")
    return pair.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"))
