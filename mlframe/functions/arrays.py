"""Column expressions over array cells: vectors, grids, one-hot, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_hot_vector(value, k: int) -> Column:
    """array<int> of length k with a 1 at the 0-based class `value`."""
    v = _col(value)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == v).cast("int"))


def argmax(arr) -> Column:
    """0-based place of the largest cell, the first on ties."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def affine(arr, shift: float, scale: float) -> Column:
    """(x - shift) / scale for each cell."""
    return F.transform(_col(arr), lambda x: (x.cast("double") - F.lit(float(shift))) / F.lit(float(scale)))


def reshape(arr, rows: int, cols: int) -> Column:
    a = _col(arr)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(a, i * cols + 1, F.lit(cols)))


def flatten(arr) -> Column:
    return F.flatten(_col(arr))


def hstack(blocks: Sequence) -> Column:
    """Feature blocks of one row side by side; scalars count as blocks of one cell."""
    return F.concat(*[_col(b) for b in blocks])


def flip_grid(arr, width: int, height: int, axis: str = "horizontal") -> Column:
    """Mirror a row-major grid left-right (`horizontal`) or top-bottom (`vertical`)."""
    rows = reshape(arr, height, width)
    if axis == "horizontal":
        return F.flatten(F.transform(rows, F.reverse))
    if axis == "vertical":
        return F.flatten(F.reverse(rows))
    raise ValueError(f"unknown axis {axis!r}")


def shift_grid(arr, width: int, height: int, dx: int = 0, dy: int = 0) -> Column:
    """Move a row-major grid by whole cells; cells from outside repeat the edge."""
    a = _col(arr)

    def source(i: Column) -> Column:
        x = F.greatest(F.lit(0), F.least(F.lit(width - 1), i % width - dx))
        y = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.floor(i / width).cast("int") - dy))
        return F.element_at(a, y * width + x + 1)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), source)


def pad_sequence(arr, maxlen: int, padding: str = "pre", truncating: str = "pre") -> Column:
    """Exactly `maxlen` ids: cut at the front or back, zeros added at the front or back."""
    a = _col(arr)
    size = F.size(a)
    start = F.greatest(F.lit(1), size - maxlen + 1) if truncating == "pre" else F.lit(1)
    kept = F.slice(a, start, F.lit(maxlen))
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(maxlen) - size))
    return F.concat(zeros, kept) if padding == "pre" else F.concat(kept, zeros)


def one_hot_tokens(arr, k: int) -> Column:
    """array<array<int>>: each id of a padded sequence as a vector of length k."""
    return F.transform(_col(arr), lambda t: one_hot_vector(t, k))


def squared_distance(a, b) -> Column:
    parts = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def sums_by_position(arr: str, n: int) -> Column:
    """n sums of an array of doubles: cells 0, n, 2n, ... to the first, 1, n + 1, ... to the second, and so on."""
    def total(c):
        return F.aggregate(F.filter(arr, lambda x, i: i % n == c), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[total(c) for c in range(n)])
